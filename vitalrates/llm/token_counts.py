"""Token counts of a byte-level BPE by a lazily compiled deterministic transducer.

States are byte prefixes of pre-tokens. A transition knows the next state and the change of the token count it emits, so
the output of a run is the sum along the path. The state of a prefix holds the last token of its encoding: of all
vocabulary tokens that end the prefix, exactly one can follow the last token of what is left of it, and two tokens can
follow each other when encoding their joined bytes gives the same two back, which undoing merges by rank decides.

Texts are cut into chunks. The first place in a chunk where white space follows something else starts a pre-token
whatever came before, so a chunk acts on any state before it as (head, tokens between the first and the last such
place, tail). These maps compose associatively, and one document's chunks are folded pairwise as in a prefix scan.
"""

from __future__ import annotations

import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.llm.common import id_and_text

# Fixed value: how the public byte-level vocabulary cuts text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_CHARS = 65_536
STATES_HELD = 1_000_000
WORDS_HELD = 1_000_000


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _State:
    __slots__ = ("next", "token", "count")

    def __init__(self, token: int, count: int):
        self.next, self.token, self.count = {}, token, count


class Transducer:
    """Token counts for one vocabulary file; states are compiled when first reached and bounded in number."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("only byte-level BPE vocabularies without a normalizer are supported")
        if spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("vocabularies that add a space in front are not supported")
        letters = _byte_letters()
        names = {bytes([b]): b for b in range(256)}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        for merge in spec["model"]["merges"]:
            left, right = (bytes(letters[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            token = len(self.parts)
            self.merged[names[left], names[right]] = token
            self.parts.append((names[left], names[right]))
            names[left + right] = token
        self.names, self.longest = names, max(map(len, names))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(PRE_TOKENS).findall
        self.sync = regex.compile(r"(?<=\S)\s")
        self.words: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.root, self.states = _State(-1, 0), 0

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is these two tokens.

        Undoes the merges at the border, newest first; a pair that would have merged before the merge just undone
        shows that the border would not have stayed.
        """
        parts, merged, limit = self.parts, self.merged, len(self.parts)
        while True:
            pair = merged.get((left, right))
            if pair is not None and pair < limit:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:  # the left token was made last: its merge ties to the left, so it happens first
                limit, left = left, parts[left][1]
            else:
                limit, right = right + 1, parts[right][0]

    def _compile(self, path: list[_State], key: bytes, end: int) -> _State:
        """The state of key[:end], from the states of its shorter prefixes."""
        for size in range(min(end, self.longest), 0, -1):
            token = self.names.get(key[end - size : end])
            if token is None:
                continue
            before = path[end - size]
            if size == end or self.follows(before.token, token):
                self.states += 1
                return _State(token, before.count + 1)
        raise AssertionError("single bytes always end a prefix")

    def pre_token(self, word: str) -> int:
        """Tokens of one pre-token: the sum of what the transitions of its bytes emit."""
        key, state, total = word.encode("utf-8"), self.root, 0
        path = [state]
        for i, byte in enumerate(key):
            step = state.next.get(byte)
            if step is None:
                after = self._compile(path, key, i + 1)
                step = state.next[byte] = (after, after.count - state.count)
            state, emitted = step
            total += emitted
            path.append(state)
        if self.states > STATES_HELD:
            self._clear()
        if len(word) <= 64:
            if len(self.words) > WORDS_HELD:
                self.words.clear()
            self.words[word] = total
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; special strings in it are one token each, as the library counts them by default."""
        if self.cut is not None and any(s in text for s in self.special):
            spans = self.cut.split(text)
            return sum(map(self.count, spans)) + len(spans) - 1
        known, total = self.words, 0
        for word in self.find(text):
            n = known.get(word)
            total += self.pre_token(word) if n is None else n
        return total

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, tokens between, tail) of a chunk; a chunk without a safe place is all head and has no tail."""
        first = self.sync.search(chunk)
        if first is None:
            return chunk, 0, None
        head, rest = chunk[: first.start()], chunk[first.start() :]
        last = None
        for last in self.sync.finditer(rest):
            pass
        if last is None:
            return head, 0, rest
        return head, self.count(rest[: last.start()]), rest[last.start() :]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if a[2] is None and b[2] is None:
            return a[0] + b[0], 0, None
        if a[2] is None:
            head, n, tail = self.chunk_map(a[0] + b[0])
            if tail is None:
                return head, b[1], b[2]
            return head, n + self.count(tail) + b[1], b[2]
        if b[2] is None:
            _, n, tail = self.chunk_map("x" + a[2] + b[0])
            return a[0], a[1] + n, tail
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def fold(self, maps: list[tuple]) -> int:
        """Tokens of a document from its chunks' maps, composed pairwise."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.count(head) + n + (self.count(tail) if tail else 0)


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk_chars: int = CHUNK_CHARS, **columns) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    NULL and empty texts have no tokens; repeated rows each give a row; extra columns are ignored. `path` names the
    vocabulary file and must be readable on every executor. Of a text longer than `chunk_chars` every chunk is a row of
    its own; what a document gathers at the end is a head and a tail for each chunk.
    """
    base = id_and_text(docs, **columns)
    chunks = F.greatest(F.ceil(F.length("text") / F.lit(chunk_chars)), F.lit(1)).cast("int")
    parts = base.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), chunks.alias("chunks"), "text",
        F.xxhash64("text").alias("key"),
        F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"),
    ).select(
        "doc_id", "n_bytes", "chunks", "key", "chunk",
        F.when(F.col("chunks") == 1, F.col("text"))
        .otherwise(F.substring("text", F.col("chunk") * chunk_chars + 1, F.lit(chunk_chars))).alias("text"),
    )

    def maps(batches):
        import pyarrow as pa

        machine = transducer(path)
        for batch in batches:
            whole = batch.column("chunks").to_pylist()
            found = [
                ("", machine.count(text), "") if n == 1 else machine.chunk_map(text)
                for n, text in zip(whole, batch.column("text").to_pylist())
            ]
            heads, counts, tails = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "n_bytes", "chunks", "key", "chunk")]
                + [pa.array(heads, pa.string()), pa.array(counts, pa.int64()), pa.array(tails, pa.string())],
                names=["doc_id", "n_bytes", "chunks", "key", "chunk", "head", "tokens", "tail"],
            )

    mapped = parts.mapInArrow(
        maps, "doc_id long, n_bytes long, chunks int, key long, chunk int, head string, tokens long, tail string"
    )
    # Short texts are groups too, spread by their id, so that the chunks are mapped in one pass.
    grouped = mapped.groupBy("doc_id", "n_bytes", "key").agg(
        F.collect_list(F.when(F.col("chunks") > 1, F.struct("chunk", "head", "tokens", "tail"))).alias("maps"),
        F.count(F.when(F.col("chunk") == 0, 1)).alias("copies"),
        F.max(F.when(F.col("chunks") == 1, F.col("tokens"))).alias("tokens"),
    )

    def folded(batches):
        import pyarrow as pa

        machine = transducer(path)
        for batch in batches:
            ids, sizes, counts = [], [], []
            for row in batch.to_pylist():
                total = row["tokens"]
                if row["maps"]:
                    own = {m["chunk"]: (m["head"], m["tokens"], m["tail"]) for m in row["maps"]}
                    total = machine.fold([own[k] for k in sorted(own)])
                ids += [row["doc_id"]] * row["copies"]
                sizes += [row["n_bytes"]] * row["copies"]
                counts += [total] * row["copies"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, sizes, counts)], names=["doc_id", "n_bytes", "n_tokens"]
            )

    out = grouped.mapInArrow(folded, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
