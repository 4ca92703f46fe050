"""Secret scan with corpus-wide ownership.

One pass finds candidate spans in whole texts. The values of the candidates, as hashes, are then counted over the
whole corpus by distinct owners (the ``source`` of a document): a value that many owners carry is a
copied example, one that few own looks live. Base kinds (assign, access, hex) are always reported; a candidate of
kind ``owned``, a long mixed token without a telling name, is reported only if at most LIVE_OWNERS own it.

Defined cases: a null text counts as empty; null owners count as one owner of their own; every row gets its own result
row, repeated or not, whatever doc_id is; a text without candidates has the hash of the empty string; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packaudit.llm.columns import free
from packaudit.session import stage

KINDS = ["assign", "access", "hex", "owned"]
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
OWNED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A text without any of these has no candidate.
HINT = r"AKIA|[0-9a-f]{32}|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{20})[A-Za-z+/_=-]*+[0-9]"
NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey"]
#: Values owned by at most so many sources look live; by more, copied.
LIVE_OWNERS = 3
CANDIDATE = "array<struct<kind:int,start:long,end:long,value:string>>"
MASK = "[secret]"


def _mixed(token: str) -> bool:
    """Digits and letters in numbers, and no small set of characters."""
    digits = sum(c.isdigit() for c in token)
    if digits < 4 or len(token) - digits < 4:
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= 3.0


def base_candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the base kinds, by start and then kind."""
    found = [(0, m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(1, m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    found += [(2, m.start(), m.end(), m.group()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda x: (x[1], x[0]))


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """Base candidates, and mixed tokens that touch none of them."""
    base = base_candidates(text)
    taken, more, i = sorted((s, e) for _, s, e, _ in base), [], 0
    for m in OWNED.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if not any(s < m.end() and m.start() < e for s, e in taken[i:i + 3]) and _mixed(m.group()):
            more.append((3, m.start(), m.end(), m.group()))
    return sorted([*base, *more], key=lambda x: (x[1], x[0]))


def hashed(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _hinted(text: Column) -> Column:
    low = F.lower(text)
    named = F.lit(False)
    for name in NAMES:
        named = named | F.contains(low, F.lit(name))
    return named | text.rlike(HINT)


def find(docs: DataFrame, owner: str = "source") -> DataFrame:
    """row, doc_id, owner and the candidates of each document, staged; values only as hashes."""
    text = F.coalesce("text", F.lit(""))
    inner = docs.select("doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("\u0000")).alias("owner"),
                        F.when(_hinted(text), text).alias("t"))
    kind = inner.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e, "value": hashed(v)} for k, s, e, v in candidates(t)] if t else []
                     for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, shape)],
                                             ["doc_id", "owner", "found"])

    out = inner.mapInArrow(run, f"doc_id {kind}, owner string, found {CANDIDATE}")
    return stage(out.select(F.monotonically_increasing_id().alias("row"), "*"), "credentials")


def ownership(found: DataFrame) -> DataFrame:
    """value, n_owners, n_uses over the corpus; combined before each shuffle."""
    each = found.select("owner", F.explode("found").alias("c")).select("owner", F.col("c.value").alias("value"))
    return (each.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_uses")))


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """Per document: row, doc_id and ``found`` with kind, start, end and whether the value looks live.

    Only rows with candidates pass the join with ownership.
    """
    found = find(docs, owner)
    owned = ownership(found)
    used = found.where(F.size("found") > 0).select("row", "doc_id", F.explode("found").alias("c"))
    judged = (used.select("row", "doc_id", "c.*").join(owned, "value")
              .withColumn("live", F.col("n_owners") <= LIVE_OWNERS)
              .where((F.col("kind") < 3) | F.col("live")))
    kept = (judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("spans")))
    none = F.array().cast("array<struct<start:long,kind:int,end:long,live:boolean>>")
    return (found.where(F.size("found") > 0).select("row", "doc_id").join(kept, "row", "left")
            .unionByName(found.where(F.size("found") == 0).select("row", "doc_id", none.alias("spans")), allowMissingColumns=True)
            .select("row", "doc_id", F.coalesce("spans", none).alias("spans")))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, owner: str = "source") -> DataFrame:
    """The query's digest: counts of the base kinds, hash of their spans, all spans, and how many look live or copied."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    kinds = F.transform(spans, lambda s: s["kind"])
    count = [F.size(F.filter(kinds, lambda k: k == n)).cast("long").alias(f"n_{name}") for n, name in enumerate(KINDS)]
    return scan(docs, owner).select(
        "doc_id", *count[:3], F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"), _text(spans).alias("spans"),
        count[3], F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: ~s["live"])).cast("long").alias("n_copied"))


def masked(text: str, live: list[str]) -> str:
    """The text with every base span, and every owned span whose value is in ``live``, replaced by MASK."""
    out, at = [], 0
    for kind, start, end, value in candidates(text):
        if kind == 3 and hashed(value) not in live:
            continue
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, owner: str = "source") -> DataFrame:
    """The documents with their secrets replaced by MASK; ``n_chars``, where there is one, follows the text.

    Only texts with a hint of a candidate are staged and rewritten; the others pass as they are.
    """
    hinted = _hinted(F.coalesce("text", F.lit("")))
    columns = docs.columns
    row, named = free(columns, "__row", "__live")
    held = stage(docs.where(hinted).select(F.monotonically_increasing_id().alias(row), *columns), "hinted")
    found = find(held.select(F.col(row).alias("doc_id"), F.col(owner).alias("owner"), "text"), "owner")
    live = (found.select("doc_id", F.explode("found").alias("c")).where("c.kind = 3")
            .select(F.col("doc_id").alias(row), F.col("c.value").alias("value"))
            .join(ownership(found).where(F.col("n_owners") <= LIVE_OWNERS), "value")
            .groupBy(row).agg(F.collect_set("value").alias(named)))
    joined = held.join(live, row, "left").select(*columns, F.coalesce(named, F.array().cast("array<string>")).alias(named))

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, live: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, list(x)) for t, x in zip(text, live)], dtype=object)

    clear = joined.withColumn("text", rewrite("text", named))
    if "n_chars" in columns:
        clear = clear.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.where(~hinted).unionByName(clear.select(*columns))
