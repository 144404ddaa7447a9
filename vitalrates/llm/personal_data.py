"""Personal data and the terms that give protected entities away.

Base spans (email, ip, card, phone) are found by fixed patterns. The corpus then tells how much a term says about a
protected entity: with n documents, n(e) holding the entity, n(t) the term, and n(e,t) the term within a few words of
the entity, the disclosure is log(n n(e,t) / (n(e) n(t))) / log(n / n(e)): the share of the entity's information that the
term carries, 1 when the term occurs nowhere else. Terms above one threshold for some entity are generalised, above a higher
one removed, wherever they occur: a term beside the entity in one document points to it from every other one.

A first pass over the texts counts, a second one marks. The second carries a bit table of the disclosing terms' hashes, of one
size whatever their number, and the marked words are compared with the terms themselves by a join.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalrates.llm.common import id_and_text
from vitalrates.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalise", "remove")
WINDOW = 8
MIN_SUPPORT = 2
GENERALISE_AT, REMOVE_AT = 0.6, 0.85
COUNTS_HELD = 400_000
TABLE_BITS = 1 << 23

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from every later one, so a match starts a run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{2,}")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, walking from one @ to the next so that long runs stay linear."""
    out, done, at = [], 0, text.find("@")
    while at != -1:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            done = match.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind in the order of KINDS, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def entity(kind: str, text: str) -> str:
    """One spelling per entity: addresses in lower case, numbers as digits."""
    body = text.lower() if kind == "email" else text if kind == "ip" else "".join(c for c in text if c in "0123456789")
    return f"{kind}:{body}"


def _free_words(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The words outside every base span, in order."""
    taken = sorted((a, b) for _, a, b in spans)
    at, end = 0, 0  # spans of different kinds may overlap; `end` is how far those seen so far reach
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            end = max(end, taken[at][1])
            at += 1
        if end <= m.start():
            yield m


def neighbours(text: str, spans: list[tuple[str, int, int]], window: int) -> set[tuple[str, str]]:
    """(entity, term) for the nearest `window` words on either side of each entity, outside every base span."""
    if not spans:
        return set()
    places = np.fromiter((x for m in _free_words(text, spans) for x in m.span()), dtype=np.int64).reshape(-1, 2)
    out = set()
    for kind, start, end in spans:
        at, name = bisect_right(places[:, 1], start), entity(kind, text[start:end])
        after = np.searchsorted(places[:, 0], end)
        for a, b in (*places[max(0, at - window) : at].tolist(), *places[after : after + window].tolist()):
            out.add((name, text[a:b].lower()))
    return out


COUNTED = "entity string, term string, texts long"


def _count(window: int):
    """In how many texts each entity, each word and each pair of neighbours occurs; NULL for both counts the texts."""

    def count(batches):
        import pyarrow as pa

        seen: Counter = Counter()

        def counted():
            names = [pa.array([key[k] for key in seen], pa.string()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*names, pa.array(list(seen.values()), pa.int64())], names=["entity", "term", "texts"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                seen[None, None] += 1
                seen.update((None, w) for w in {w.lower() for w in set(_WORD.findall(text))})
                seen.update((e, None) for e in {entity(k, text[a:b]) for k, a, b in spans})
                seen.update(neighbours(text, spans, window))
                if len(seen) > COUNTS_HELD:
                    yield counted()
                    seen.clear()
        if seen:
            yield counted()

    return count


def disclosing_terms(counts: DataFrame, min_support: int, at_least: float) -> DataFrame:
    """term and its largest disclosure about any entity beside which it stands in at least `min_support` documents."""
    summed = cut_lineage(counts.groupBy("entity", "term").agg(F.sum("texts").alias("texts")))
    n = float(summed.where("entity IS NULL AND term IS NULL").agg(F.sum("texts")).first()[0] or 0)
    pairs = summed.where(F.col("entity").isNotNull() & F.col("term").isNotNull()).where(F.col("texts") >= min_support)
    holders = summed.where("entity IS NOT NULL AND term IS NULL").select("entity", F.col("texts").alias("holders"))
    words = summed.where("entity IS NULL AND term IS NOT NULL").select("term", F.col("texts").alias("holding"))
    share = F.log(n * F.col("texts") / (F.col("holders") * F.col("holding"))) / F.log(n / F.col("holders"))
    known = pairs.join(holders, "entity").where(F.col("holders") < n).join(words, "term")
    return known.groupBy("term").agg(F.max(share).alias("disclosure")).where(F.col("disclosure") >= at_least)


def _bit_table(terms: DataFrame) -> bytes:
    """One bit for every value of a term's hash, set if some term has it: TABLE_BITS / 8 bytes."""
    place = F.crc32(F.col("term").cast("binary")) % TABLE_BITS
    parts = terms.select(place.alias("place")).select(
        F.floor(F.col("place") / 32).alias("word"), F.expr("shiftleft(1L, CAST(place % 32 AS INT))").alias("bit")
    ).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most TABLE_BITS / 32 rows
    table = np.zeros(TABLE_BITS // 32, dtype="<u4")
    table[parts["word"].to_numpy(dtype=np.int64)] = parts["bits"].to_numpy(dtype=np.int64)
    return table.tobytes()


MARKED = "doc_id long, base array<struct<kind:string,start:int,end:int>>, marked array<struct<term:string,start:int,end:int>>"


def _mark(table: bytes):
    """Per text: its base spans, and the words outside them whose hash is in the table."""
    any_set = any(table)

    def mark(batches):
        import pyarrow as pa

        base = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        words = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        hits: dict[str, bool] = {}

        def hit(word: str) -> bool:
            found = hits.get(word)
            if found is None:
                if len(hits) > COUNTS_HELD:
                    hits.clear()
                h = zlib.crc32(word.lower().encode()) % TABLE_BITS
                found = hits[word] = bool(table[h >> 3] >> (h & 7) & 1)
            return found

        for batch in batches:
            # A long text has many spans, so output goes on in short batches.
            texts = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            while part := list(islice(texts, 256)):
                bases, marks = [], []
                for _, text in part:
                    spans = base_spans(text)
                    bases.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                    found = _free_words(text, spans) if any_set and any(map(hit, set(_WORD.findall(text)))) else ()
                    marks.append([
                        {"term": m.group().lower(), "start": m.start(), "end": m.end()} for m in found if hit(m.group())
                    ])
                columns = [pa.array([i for i, _ in part], pa.int64()), pa.array(bases, base), pa.array(marks, words)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "marked"])

    return mark


def personal_data(
    docs: DataFrame, *, window: int = WINDOW, min_support: int = MIN_SUPPORT, generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT, **columns,
) -> DataFrame:
    """One row per input row: doc_id, base and terms (arrays of kind, start, end).

    A pair of entity and term counts from `min_support` documents on; one document's neighbours of its own entity would
    otherwise all be terms. NULL and empty texts have no spans; rows that repeat an id and a text each count as a document
    and get the same spans; an entity that every document holds has no disclosing terms. Extra columns are ignored.
    """
    base = id_and_text(docs, **columns)
    counts = base.select("text").mapInArrow(_count(window), COUNTED)
    known = cut_lineage(disclosing_terms(counts, min_support, generalise_at))
    found = cut_lineage(base.mapInArrow(_mark(_bit_table(known)), MARKED))
    found = found.select("*", F.monotonically_increasing_id().alias("row"))
    kind = F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise")
    marked = found.select("row", F.explode("marked").alias("x")).select("row", "x.*")
    spans = marked.join(known, "term").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct(kind.alias("kind"), "start", "end"))).alias("terms")
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return found.join(spans, "row", "left").select("doc_id", "base", F.coalesce("terms", none).alias("terms"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts and span texts of `personal_data`."""
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "terms")).alias("spans"),
    )


def sanitised(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and the text with base spans as [KIND], removed terms gone and generalised ones as their initial and a dot.

    Needs unique doc_ids. Where spans overlap, the one that starts first, then the longer, is applied.
    """

    def rewrite(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, base, terms in zip(*(batch.column(c).to_pylist() for c in ("text", "base", "terms"))):
                parts, done = [], 0
                for x in sorted((base or []) + (terms or []), key=lambda x: (x["start"], -x["end"])):
                    if x["start"] >= done:
                        word = text[x["start"] : x["end"]]
                        new = {"remove": "", "generalise": word[:1] + "."}.get(x["kind"], f"[{x['kind'].upper()}]")
                        parts += [text[done : x["start"]], new]
                        done = x["end"]
                out.append("".join(parts) + text[done:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return id_and_text(docs).join(found, "doc_id").mapInArrow(rewrite, "doc_id long, text string")

