"""Cross-tokenizer alignment (operator 13).

A text (with a space before it) is cut into tokens by two tokenizers, a byte-level BPE (A) and one of pieces (B). Both
cover the same bytes. Tokens are nodes of a bipartite graph, an A and a B token that share a byte are linked. The
connected components, by union-find, are the least groups of A tokens and B tokens that cover the same bytes: wherever
tokens of both end, no link crosses, and elsewhere one does. Two tokens share a byte exactly if one of them holds the
other's first one, so links are made in one step: from every token to the one of the other kind that holds its first
byte, once for both where they begin together. There are fewer links than tokens, however long the groups are.

An id pair's count is the number of links of the whole corpus that hold it. Pairs are counted in three steps: within a
document, within a block of documents (of ``BLOCK_CHARS`` characters or one document), and over blocks by a grouped sum.
A pair that every text holds is one row of a block before anything is shuffled. The counts return to the blocks that have
the pair, and a block's documents meet the counts of its pairs in one group, whose size the block bounds.

All arithmetic is on arrays of about ``ROUND_CHARS`` characters of texts; union-find is hooking to the smaller root and
pointer jumping, in a logarithmic number of passes over the links. The first pass stores its rows
(:func:`lattica.llm.common.cut`), so that texts are encoded once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored_as

#: Vocabulary files of public tokenizers.
A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of texts whose tokens are held at once, and whose pairs are counted together; or one text.
ROUND_CHARS, BLOCK_CHARS = 1_000_000, 8_000_000
#: Pairs of a block in one stored row.
PAIR_ROW = 20_000
#: How a byte-level vocabulary of this kind splits texts before merging, a fixed value of the format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable Latin-1 ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of a text and the bytes of every id, of one tokenizer; ``table`` has an id's digits and a mark after them."""

    def __init__(self, spelled: list[bytes], marks: str):
        self.spelled = spelled
        self.size = np.array([len(b) for b in spelled], np.int64)
        wide = len(str(max(len(spelled) - 1, 0))) + 1
        self.table = np.array([[f"{k}{m}".encode() for m in [*marks, ""]] for k in range(len(spelled))], f"S{wide}")


class ByteEncoder(Encoder):
    """A byte-level BPE vocabulary file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in read.get("added_tokens", []) if t.get("special")}
        vocab = {w: k for w, k in read["model"]["vocab"].items() if w not in special}
        spelled = {k: bytes(letters[c] for c in w) for w, k in vocab.items()}
        ranks = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in read["model"]["merges"]]
        if any(a >= b for a, b in zip(ranks, ranks[1:])):
            raise ValueError(f"{path}: ids aren't in the order of merges")
        super().__init__([spelled.get(k, b"") for k in range(max(spelled) + 1)], ",|")
        self._encoding = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks={b: k for k, b in spelled.items()}, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self._encoding.encode_to_numpy(" " + text, disallowed_special=()), np.int64)


class PieceEncoder(Encoder):
    """A model of pieces with byte fallback, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = lambda k: bytes([int(m.id_to_piece(k)[3:5], 16)]) if m.IsByte(k) else m.id_to_piece(k).replace("▁", " ").encode()
        super().__init__([piece(k) for k in range(m.get_piece_size())], ",;")

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text), np.int64)


@lru_cache(maxsize=2)
def encoders(a_path: str, b_path: str) -> tuple[ByteEncoder, PieceEncoder]:
    return ByteEncoder(a_path), PieceEncoder(b_path)


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of n nodes, by union-find over the links (u, v)."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        parent[np.maximum(a, b)] = np.minimum(a, b)  # of several links of one root any will do: the others come again
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def align(a: Encoder, b: Encoder, texts: list[str]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, np.ndarray]]:
    """For rounds of texts: (their NUMBERS as columns, groups as text, document and id pair of every link)."""
    for at in _rounds(texts):
        yield _aligned(a, b, texts[at])


def _rounds(texts: list[str]) -> Iterator[slice]:
    first, chars = 0, 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= ROUND_CHARS:
            yield slice(first, k + 1)
            first, chars = k + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def _holder(first: np.ndarray, length: int) -> np.ndarray:
    """For each byte the token that holds it, given the tokens' first bytes."""
    begins = np.zeros(length, np.int32)
    begins[first] = 1
    return np.cumsum(begins) - 1


def _aligned(a: Encoder, b: Encoder, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    both = []
    for text in texts:
        x, y = none, none
        if text:
            p, q, want = a.ids(text), b.ids(text), b" " + text.encode()
            if b"".join(map(a.spelled.__getitem__, p.tolist())) == want == b"".join(map(b.spelled.__getitem__, q.tolist())):
                x, y = p, q
        both.append((x, y))
    na, nb = (np.array([len(t[k]) for t in both], np.int64) for k in (0, 1))
    ours, theirs = (np.concatenate([none, *(t[k] for t in both)]) for k in (0, 1))
    # both cut the same bytes, so that one count of bytes over all texts places the tokens of both
    sa, sb = a.size[ours], b.size[theirs]
    length = int(sa.sum())
    sa, sb = np.cumsum(sa) - sa, np.cumsum(sb) - sb
    over = _holder(sb, length)[sa]  # the B token that holds an A token's first byte
    under = _holder(sa, length)[sb]
    later = np.nonzero(sa[under] != sb)[0]  # B tokens that begin within an A token
    u, v = np.concatenate([np.arange(len(ours)), under[later]]), np.concatenate([over, later])
    root = roots(len(ours) + len(theirs), u, v + len(ours))
    # groups follow one another in the text, and the smallest node of each is its first A token
    heads = root[: len(ours)] == np.arange(len(ours))
    ga = np.cumsum(heads) - 1
    gb = ga[root[len(ours) :]]
    doc = np.repeat(np.arange(len(texts)), na)
    links = doc[u]
    numbers = np.stack([na, nb, np.bincount(doc[heads], minlength=len(texts)), np.bincount(links, minlength=len(texts))])
    # the groups as text: members in their places, each followed by its mark
    a_size, b_size = np.bincount(ga), np.bincount(gb)
    ends_a, ends_b = np.append(ga[1:] != ga[:-1], True)[: len(ga)], np.append(gb[1:] != gb[:-1], True)[: len(gb)]
    mark = ends_b.astype(np.int64)
    mark[np.cumsum(nb)[nb > 0] - 1] = 2  # nothing after the last of a text
    out = np.empty(len(ours) + len(theirs), max(a.table.dtype, b.table.dtype))
    out[np.arange(len(ours)) + (np.cumsum(b_size) - b_size)[ga]] = a.table[ours, ends_a.astype(np.int64)]
    out[np.arange(len(theirs)) + np.cumsum(a_size)[gb]] = b.table[theirs, mark]
    place = np.concatenate([[0], np.cumsum(na + nb)])
    groups = [out[s:e].tobytes().replace(b"\0", b"").decode() for s, e in zip(place, place[1:])]
    return numbers, groups, links, ours[u] * len(b.spelled) + theirs[v]


def _counted(doc: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each of n documents, pairs by document and pair, how often)."""
    keys, times = np.unique(doc << np.int64(40) | pair, return_counts=True)
    return np.searchsorted(keys >> 40, np.arange(n + 1)), keys & (1 << 40) - 1, times


def _encoded(docs: DataFrame, names: list[str], text_col: str, a_path: str, b_path: str) -> DataFrame:
    """A row for each text, with the steps between its pairs and their counts, and rows of the pairs of each block."""
    kept = pa.schema([])
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kept
        a, b = encoders(a_path, b_path)
        block, chars, held = TaskContext.get().partitionId() << 32, 0, []

        def row(columns: list[pa.Array], **more: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(more.values())))
            columns = columns or [pa.nulls(n, t) for t in kept.types]
            kinds = {"block": pa.int64(), **dict.fromkeys(NUMBERS, pa.int64()), "groups": pa.string(), "steps": pa.list_(pa.int64()), "times": pa.list_(pa.int32()), "pairs": pa.list_(pa.int64()), "sums": pa.list_(pa.int64())}
            return pa.RecordBatch.from_arrays([*columns, *(more.get(k, None) if k in more else pa.nulls(n, t) for k, t in kinds.items())], names=[*names, *kinds])

        def lists(places: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(values, kind))

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal block, chars, held
            if held:
                pairs, back = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
                sums = np.bincount(back, np.concatenate([t for _, t in held]), len(pairs)).astype(np.int64)
                for k in range(0, len(pairs), PAIR_ROW):
                    p, s = pairs[k : k + PAIR_ROW], sums[k : k + PAIR_ROW]
                    ends = np.array([0, len(p)])
                    yield row([], block=pa.array([block]), pairs=lists(ends, p, pa.int64()), sums=lists(ends, s, pa.int64()))
            block, chars, held = block + 1, 0, []

        for batch in batches:
            kept = pa.schema(list(batch.schema)[1:])
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for at in _rounds(texts):
                some = texts[at]
                numbers, groups, doc, pair = _aligned(a, b, some)
                places, pairs, times = _counted(doc, pair, len(some))
                steps = np.diff(pairs, prepend=0)
                first = places[:-1][places[:-1] < places[1:]]
                steps[first] = pairs[first]
                yield row(
                    [c.slice(at.start, len(some)) for c in batch.columns[1:]], block=pa.array(np.full(len(some), block)), **dict(zip(NUMBERS, map(pa.array, numbers))),
                    groups=pa.array(groups), steps=lists(places, steps, pa.int64()), times=lists(places, times.astype(np.int32), pa.int32()),
                )
                held.append((pairs, times))
                chars += sum(map(len, some))
                if chars >= BLOCK_CHARS:
                    yield from ended()
        yield from ended()

    numbers = ", ".join(f"{c} bigint" for c in NUMBERS)
    return docs.select(F.col(text_col).alias("__align_text"), *names).mapInArrow(run, f"{ddl}block bigint, {numbers}, groups string, steps array<bigint>, times array<int>, pairs array<bigint>, sums array<bigint>")


def _pair_counts(blocks: DataFrame, b_ids: int) -> DataFrame:
    """(pair, count, best): over all blocks, and whether no pair of its B id has more."""
    all_ = blocks.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b_id", F.col("pair") % b_ids)
    top = all_.groupBy("b_id").agg(F.max("count").alias("most"))
    # at most a row for each id of the vocabulary
    return all_.join(F.broadcast(top), "b_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.where("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "sums")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.sums").alias("n"))


def translation(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, text_col: str = "text") -> DataFrame:
    """(a_id, b_id, count, best) of all id pairs linked anywhere in ``docs``; best: no pair of its B id has more links."""
    size = len(encoders(a_path, b_path)[1].spelled)
    rows = cut(_encoded(docs, [], text_col, a_path, b_path).select("block", "pairs", "sums").where("pairs is not null"))
    return _pair_counts(_exploded(rows), size).select(F.floor(F.col("pair") / size).alias("a_id"), (F.col("pair") % size).alias("b_id"), "count", "best")


def aligned(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, columns: list[str] | None = None, groups: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``columns`` of ``docs`` (default: its id) with n_a, n_b, n_groups, n_links, groups, n_best, count_sum.

    groups: "a1,a2|b1;a3|b2,b3", ids of A and B of each group, in order; or ``groups``, an expression over it, where the
    text itself isn't wanted. n_best: links of whose B id no pair has more links in the corpus than this one's; count_sum:
    the sum of the links' counts. Texts that are null or empty, or whose bytes one of the tokenizers doesn't give back,
    have no tokens: zeros and an empty text. Rows are handled one by one and repeated ones count again; ties of counts are
    all best. Columns of these names are replaced. An empty table gives an empty result.
    """
    own = [*NUMBERS, "groups", "n_best", "count_sum"]
    names = [c for c in dict.fromkeys(columns or [id_col]) if c not in own]
    aliases = [f"__align_{k}" for k in range(len(names))]
    given = docs.select(*[F.col(c).alias(x) for c, x in zip(names, aliases)], F.col(text_col).alias("__align_of"))
    size = len(encoders(a_path, b_path)[1].spelled)
    with stored_as("zstd"):
        rows = _encoded(given, aliases, "__align_of", a_path, b_path)
        rows = cut(rows.withColumn("groups", groups) if groups is not None else rows)
    pairs = _exploded(rows)
    back = pairs.select(F.col("block").alias("of"), "pair").join(_pair_counts(pairs, size), "pair")
    texts = rows.where("pairs is null").drop("pairs", "sums")
    kinds = texts.select(*aliases, *NUMBERS, "groups").schema

    def run(mine: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(known := counts.column("pair").to_numpy())
        known, count, best = known[order], counts.column("count").to_numpy()[order], counts.column("best").to_numpy()[order]
        steps, times = mine.column("steps").combine_chunks(), mine.column("times").combine_chunks()
        place = steps.offsets.to_numpy() - steps.offsets[0].as_py()
        step, n = steps.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        total = np.concatenate([[0], np.cumsum(step)])
        pair = total[1:] - np.repeat(total[place[:-1]], np.diff(place))
        at = np.searchsorted(known, pair)
        whole = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[place])
        sums = [whole(n * best[at]), whole(n * count[at])] if len(pair) else [np.zeros(len(mine), np.int64)] * 2
        return pa.table([*(mine.column(c) for c in [*aliases, *NUMBERS, "groups"]), *map(pa.array, sums)], names=[*aliases, *NUMBERS, "groups", "n_best", "count_sum"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", n_best bigint, count_sum bigint"
    out = texts.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(run, ddl)
    return out.select(*[F.col(x).alias(c) for c, x in zip(names, aliases)], *own)
