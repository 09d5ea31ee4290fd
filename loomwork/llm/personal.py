"""Personal data: base patterns as seeds, and what their contexts lead to.

Seeds are emails, IP addresses, card and phone numbers by fixed rules, and keys: hexadecimal strings of
``KEY`` characters and more with digits and letters. Tokens are runs of bytes other than white space,
quotes, brackets and ``= : , ; |``. A lexical pattern is the token before an instance, or the two
before it, in lower case, with what stands between it and the instance (``=`` or ``:``, a quote).

1. Seeds induce patterns. Candidates are those of at least ``SUPPORT`` unlike seeds, of whose places, all counted,
   at least the share ``SHARE`` are followed by a seed (which ordinary words are not).
2. One pass gathers everything that follows a candidate, identifier or not, as a graph of patterns and
   instances. An instance is told apart by its token and the two after it, so copies count once.
3. Spark scores the graph in rounds: a pattern is worth the mean of its instances' scores (smoothed, so that
   patterns of few instances are worth less), an instance what its token's patterns make likely (noisy or; seeds stay at 1).
4. Tokens that score ``CONFIDENT``, and of whose places, all counted, at least the share ``OWN`` are behind confident
   patterns (which ordinary words are not), are seeds of the next round, whose contexts induce further patterns, until
   a round brings none, at most ``ROUNDS`` times. A round so adds at most 1 / ``OWN`` times the places behind such patterns.

What follows a pattern of high confidence becomes a span of kind ``ctx`` unless it meets a base span.
Patterns are broadcast in blocks of about ``LIMIT``, each with a pass of its own.

Defined results: null text is empty; spans are in code points, end exclusive; base spans of one
kind don't overlap, those of unlike kinds may; repeated rows each get their spans; ids and other columns are
not read; an empty table gives an empty result. Tokens are told apart by 64 bits.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from loomwork.llm.words import U, blocks, hashes, mix, raw, spans, trimmed
from loomwork.session import cut

KINDS = ("email", "ip", "card", "phone", "ctx")
ROUNDS = 3
CONFIDENT = 0.7
SUPPORT = 3
SHARE = 0.05
OWN = 0.2
SMOOTH = 1.0
KEY = 32
LIMIT = 1 << 20
#: Bytes of text taken at once.
STEP = 1 << 20
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from within too, so runs are tried from their starts alone.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_KEY = re.compile(rb"(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_QUOTE = np.zeros(256, bool)
_QUOTE[list(b"\"'`")] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"=:")] = True
_GAPS = _QUOTE | _SIGN
_GAPS[[32, *range(9, 14), *b"()[]{}<>,;|"]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


class Tokens:
    """Tokens of a block of texts: their places, hashes, patterns (0: none) and what tells instances apart."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.starts, self.ends, self.row = spans(data, off, _GAPS)
        n = len(self.starts)
        self.hash = h = hashes(data, self.starts, self.ends)
        self.one, self.two = np.zeros(n, U), np.zeros(n, U)
        if n < 2:
            return
        same = self.row[1:] == self.row[:-1]
        between = np.zeros(n - 1, U)
        for k, kind in enumerate((_SIGN, _QUOTE)):
            upto = np.r_[0, np.cumsum(kind[data], dtype=np.int64)]
            between |= (upto[self.starts[1:]] > upto[self.ends[:-1]]).astype(U) << U(k)
        one = mix(h[:-1] * U(31) + between + U(1))
        self.one[1:] = np.where(same, one, U(0))
        self.two[2:] = np.where(same[1:] & same[:-1], mix(one[1:] ^ mix(h[:-2] + U(2))), U(0))

    def instances(self, at: np.ndarray) -> np.ndarray:
        """What tells chosen tokens apart: themselves and the two after them."""
        out, n = self.hash[at], len(self.hash)
        for k in (1, 2):
            to = np.minimum(at + k, n - 1)
            out = mix(out + np.where((to == at + k) & (self.row[to] == self.row[at]), self.hash[to], U(0)) + U(k))
        return out


def _texts(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts: number of the first row, bytes, starts."""
    data, off = raw(b.column(at))
    for i, j in blocks(off, STEP):
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]


EDGE = "pattern long, token long, instance long, n long"


def _edges(parts: list[tuple[np.ndarray, Tokens]]) -> pa.RecordBatch:
    """Unlike (pattern, token, instance) of chosen tokens and how often they stand; parts: numbers of tokens, with their block."""
    cols = [np.stack([np.r_[t.one[at], t.two[at]], np.tile(t.hash[at], 2), np.tile(t.instances(at), 2)], 1) for at, t in parts]
    rows = np.concatenate(cols) if cols else np.zeros((0, 3), U)
    rows, n = np.unique(rows[rows[:, 0] != 0], axis=0, return_counts=True)
    rows = rows.view(np.int64)
    return pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(3)), pa.array(n.astype(np.int64))], ["pattern", "token", "instance", "n"])


def merged(edges: DataFrame) -> DataFrame:
    return edges.groupBy("pattern", "token", "instance").agg(F.sum("n").alias("n"))


def seeds(docs: DataFrame) -> DataFrame:
    """Edges of seeds: base spans and keys."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A block at a time: the tokens of a whole batch take several times its bytes.
            for _, data, off in _texts(b, 0):
                t = Tokens(data, off)
                at = [k for k in np.flatnonzero(t.ends - t.starts >= KEY) if _KEY.fullmatch(data[t.starts[k] : t.ends[k]].tobytes())]
                for r in range(len(off) - 1):
                    text = data[off[r] : off[r + 1]].tobytes().decode()
                    for s, _, _ in base_spans(text):
                        at.append(int(np.searchsorted(t.starts, off[r] + len(text[:s].encode()), "right")) - 1)
                yield _edges([(np.unique(np.array([k for k in at if k >= 0], np.int64)), t)])

    return merged(docs.select("text").mapInArrow(trimmed(find), EDGE))


def over_blocks(docs: DataFrame, values: DataFrame, schema: str, gather) -> DataFrame:
    """What ``gather`` ([(Tokens, sorted values)]) makes of each block of texts, over all values in blocks."""
    out = None
    for part in in_blocks(values):

        def find(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, data, off in _texts(b, 0):
                    yield gather([(Tokens(data, off), part.value)])

        found = docs.select("text").mapInArrow(trimmed(find), schema)
        out = found if out is None else out.unionByName(found)
    return out


def following(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Edges of all that follows a pattern; both patterns of such a token lead to it, the other to be sorted out."""
    return merged(over_blocks(docs, patterns, EDGE, lambda parts: _edges([(np.flatnonzero(member(t.one, w) | member(t.two, w)), t) for t, w in parts])))


def leading(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Edges of all places of some tokens."""
    return merged(over_blocks(docs, tokens, EDGE, lambda parts: _edges([(np.flatnonzero(member(t.hash, w)), t) for t, w in parts])))


def tallied(docs: DataFrame, values: DataFrame, of) -> DataFrame:
    """The column of ``values`` and places: how often each stands among the hashes that ``of`` takes from Tokens."""
    name = values.columns[0]
    return tallies(docs, values, of).groupBy(name).agg(F.sum("n").alias("places"))


def tallies(docs: DataFrame, values: DataFrame, of) -> DataFrame:
    """The same task by task: the column of ``values`` and n."""
    name, out = values.columns[0], None
    for part in in_blocks(values):

        def tally(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            # One count per value and task: a row per block of text would be as many as values times blocks.
            n = np.zeros(len(part.value), np.int64)
            for b in batches:
                for _, data, off in _texts(b, 0):
                    for x in of(Tokens(data, off)):
                        np.add.at(n, np.searchsorted(part.value, x[member(x, part.value)]), 1)
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(part.value[seen].view(np.int64)), pa.array(n[seen])], [name, "n"])

        found = docs.select("text").mapInArrow(trimmed(tally), f"{name} long, n long")
        out = found if out is None else out.unionByName(found)
    return out


def places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, places: how often each stands."""
    return tallied(docs, patterns, lambda t: (t.one, t.two))


def own_tokens(docs: DataFrame, tokens: DataFrame, edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """Of ``tokens`` those that stand behind ``patterns`` often enough; a place behind two of them counts twice."""
    behind = edges.join(patterns.select("pattern"), "pattern", "left_semi").groupBy("token").agg(F.sum("n").alias("behind"))
    return tokens.join(behind, "token").join(tallied(docs, tokens, lambda t: (t.hash,)), "token").where(F.col("behind") >= OWN * F.col("places")).select("token")


def in_blocks(values: DataFrame, limit: int | None = None) -> list:
    """Broadcast sorted arrays of the longs of ``values`` (one column, unlike), about ``limit`` each; at least one."""
    limit = limit or LIMIT
    sc, name = values.sparkSession.sparkContext, values.columns[0]
    n = max(1, -(-values.count() // limit))
    out = []
    for k in range(n):
        part = np.array([r[0] for r in values.where(F.pmod(F.col(name), F.lit(n)) == k).toLocalIterator()], np.int64)
        out.append(sc.broadcast(np.sort(part.view(U))))
    return out


def member(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(x), bool)
    return wanted[np.minimum(np.searchsorted(wanted, x), len(wanted) - 1)] == x


def confident_patterns(docs: DataFrame) -> DataFrame:
    """pattern, confidence, support."""
    known, patterns = cut(seeds(docs)), None
    for _ in range(ROUNDS):
        support = cut(known.groupBy("pattern").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("held")).where(F.col("support") >= SUPPORT))
        support = cut(support.join(places(docs, support.select("pattern")), "pattern").where(F.col("held") >= SHARE * F.col("places")).select("pattern", "support"))
        edges = following(docs, support.select("pattern")).join(support.select("pattern"), "pattern", "left_semi")
        is_seed = known.select("pattern", "token", "instance", F.lit(True).alias("seed"))
        edges = cut(edges.join(is_seed, ["pattern", "token", "instance"], "left").withColumn("seed", F.coalesce("seed", F.lit(False))))
        patterns, tokens = scored(edges)
        patterns = cut(patterns.join(support, "pattern").where(F.col("confidence") >= CONFIDENT))
        # Tokens that confident patterns lead to, and that were not seeds yet.
        new = cut(tokens.where(F.col("likely") >= CONFIDENT).select("token").join(known.select("token"), "token", "left_anti"))
        if new.isEmpty():
            return patterns
        new = cut(own_tokens(docs, new, edges, patterns))
        if new.isEmpty():
            return patterns
        known = cut(merged(known.unionByName(leading(docs, new))))
    return patterns


def scored(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence) and (token, likely) after two exchanges of scores. edges: pattern, token, instance, seed."""
    score = F.col("seed").cast("double")

    def worth(e: DataFrame) -> DataFrame:
        return e.groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + SMOOTH)).alias("confidence"))

    def likely(p: DataFrame) -> DataFrame:
        by = edges.select("pattern", "token").distinct().join(p, "pattern")
        return by.groupBy("token").agg((1 - F.exp(F.sum(F.log(1.0 - F.least("confidence", F.lit(0.999)))))).alias("likely"))

    tokens = likely(worth(edges.withColumn("score", score)))
    again = edges.join(tokens, "token").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.col("likely")))
    patterns = worth(again)
    # A token is only as likely as the patterns that are sure themselves.
    return patterns, likely(patterns.where(F.col("confidence") >= CONFIDENT))


_SPAN = StructType().add("start", LongType()).add("kind", IntegerType()).add("end", LongType())
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def free_name(names: list[str], wish: str) -> str:
    while wish in names:
        wish = "_" + wish
    return wish


def with_spans(docs: DataFrame, name: str = "spans") -> DataFrame:
    """``docs`` with all spans of every row's text, sorted by start, kind and end; a column of that name is replaced."""
    docs = docs.select(*[c for c in docs.columns if c != name])
    text_at, held = docs.columns.index("text"), len(docs.columns)
    schema = StructType([*docs.schema.fields]).add(name, ArrayType(_SPAN))
    parts = in_blocks(cut(confident_patterns(docs).select("pattern")))

    def step(part, first: bool, last: bool):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                more = [set() for _ in range(len(b))] if first else [{(x["start"], 4, x["end"]) for x in r} for r in b.column(held).to_pylist()]
                for i, data, off in _texts(b, text_at):
                    t = Tokens(data, off)
                    hit = np.flatnonzero(member(t.one, part.value) | member(t.two, part.value))
                    for at in np.split(hit, np.flatnonzero(np.diff(t.row[hit])) + 1) if len(hit) else ():
                        r = int(t.row[at[0]])
                        whole = data[off[r] : off[r + 1]]
                        place = np.r_[0, np.cumsum((whole & 0xC0) != 0x80)]
                        for s, e in zip(t.starts[at] - off[r], t.ends[at] - off[r], strict=True):
                            left = whole[s:e].tobytes().decode().rstrip(".!?#$%&*")
                            if any(map(str.isalnum, left)):
                                more[i + r].add((int(place[s]), 4, int(place[s]) + len(left)))
                rows = []
                for text, extra in zip(b.column(text_at), more, strict=True):
                    found = sorted(extra)
                    if last:
                        found = all_spans(text.as_py() or "", found)
                    rows.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                yield pa.RecordBatch.from_arrays([*b.columns[:held], pa.array(rows, _ARROW)], schema.names)

        return find

    for k, part in enumerate(parts):
        docs = docs.mapInArrow(trimmed(step(part, k == 0, k == len(parts) - 1)), schema)
    return docs


def all_spans(text: str, extra: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and of ``extra`` what meets none of them."""
    base = base_spans(text)
    if not extra:
        return base
    reach: list[int] = []
    for _, _, e in base:
        reach.append(max(e, reach[-1]) if reach else e)
    starts = [s for s, _, _ in base]
    out = list(base)
    for s, k, e in extra:
        # Of the base spans that begin before the end, the one that reaches farthest.
        j = bisect_right(starts, e - 1)
        if not j or reach[j - 1] <= s:
            out.append((s, k, e))
    return sorted(out)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; columns as they were."""
    names, schema = docs.columns, docs.schema
    text_at = names.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found in zip(b.column(text_at), b.column(len(names)).to_pylist(), strict=True):
                text = text.as_py()
                if text and found:
                    parts, done = [], 0
                    for x in found:
                        if x["end"] > done:
                            if x["start"] >= done:
                                parts += [text[done : x["start"]], f"[{KINDS[x['kind']].upper()}]"]
                            done = x["end"]
                    text = "".join(parts) + text[done:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([*b.columns[:text_at], pa.array(out, b.column(text_at).type), *b.columns[text_at + 1 : len(names)]], names)

    return with_spans(docs, free_name(names, "spans")).mapInArrow(trimmed(mask), schema)


def number(kind: int) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def listed(found: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5(spark, sf_dir: str) -> DataFrame:
    out = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"] < 4)
    return out.select("doc_id", *[number(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), number(4).alias("n_ctx"))
