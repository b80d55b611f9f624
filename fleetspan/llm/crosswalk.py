"""Alignment of two tokenizers over the same texts: common cuts, linked tokens, and how often ids are linked in all texts.

Both tokenizers' tokens are byte ranges of one text. One vector of states, a lane for every text of a batch (several for a
long one), moves a pointer into A's tokens and one into B's: the pointer whose token ends first goes on, and where both end
a link and a cut are emitted and both go on. Lanes that are through are dropped from the vector.

Two linked tokens end together, so the shorter is the end of the longer: the id pairs that can be linked at all are known
from the two vocabularies, some hundred thousand whatever the texts. Counts by pair are therefore a bounded table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytepairs import PATTERN
from .store import stored

LANE_TOKENS = 1024  # tokens of A that one lane goes through at most
STEP_BYTES = 1_500_000  # of text encoded together
COMMA, BAR, SEMICOLON = b",|;"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _table(tokens: list[bytes], width: int) -> SimpleNamespace:
    """Token bytes laid end to end, with their digits for printing ids."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    digits = np.zeros((len(tokens), width), np.uint8)
    for i in range(len(tokens)):
        d = str(i).encode()
        digits[i, : len(d)] = np.frombuffer(d, np.uint8)
    return SimpleNamespace(flat=np.frombuffer(b"".join(tokens), np.uint8), lengths=lengths, first=np.cumsum(lengths) - lengths, digits=digits)


def linkable_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted codes ``a * len(b) + b`` of all pairs of ids of which one's bytes end with the other's."""
    by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
    for tokens, index in zip((a, b), by_bytes):
        for i, t in enumerate(tokens):
            if t:
                index.setdefault(t, []).append(i)
    codes = set()
    for i, t in enumerate(a):
        for k in range(len(t)):
            codes.update(i * len(b) + j for j in by_bytes[1].get(t[k:], ()))
    for j, t in enumerate(b):
        for k in range(1, len(t)):
            codes.update(i * len(b) + j for i in by_bytes[0].get(t[k:], ()))
    return np.array(sorted(codes), np.int64)


def load_vocabularies(byte_vocabulary: str, piece_model: str) -> SimpleNamespace:
    """What tasks need of both tokenizers: plain types of a few MB, fixed by the two files."""
    import sentencepiece

    definition, model = json.load(open(byte_vocabulary, encoding="utf-8")), open(piece_model, "rb").read()
    letters = _byte_letters()
    vocabulary, special = definition["model"]["vocab"], {t["content"]: t["id"] for t in definition["added_tokens"]}
    joined = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in definition["model"]["merges"]]
    if joined != sorted(joined):
        raise ValueError(f"the merges of {byte_vocabulary} are not in the order of their ids")
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    a = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
        a[i] = token
    second = sentencepiece.SentencePieceProcessor(model_proto=model)
    b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in range(second.get_piece_size())]
    width = len(str(max(len(a), len(b))))
    return SimpleNamespace(ranks=ranks, model=model, a=_table(a, width), b=_table(b, width), pairs=linkable_pairs(a, b), encoders=None)


def _encoders(v: SimpleNamespace):
    if v.encoders is None:  # once a worker
        import sentencepiece
        import tiktoken

        # merges in the order of ids are ranks; without special tokens their strings in a text are plain text
        v.encoders = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={}), sentencepiece.SentencePieceProcessor(model_proto=v.model)
    return v.encoders


def _joined(ids: np.ndarray, table: SimpleNamespace) -> np.ndarray:
    lengths = table.lengths[ids]
    return table.flat[np.repeat(table.first[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]


def encode_both(texts: list[str], v: SimpleNamespace) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids of A and B for each text; none where the tokens' bytes are not those of a space and the text."""
    first, second = _encoders(v)
    none = np.empty(0, np.int64)
    some = [t for t in texts if t]
    b_ids = second.encode(some, num_threads=1) if some else []
    out, k = [], 0
    for t in texts:
        pair = (none, none)
        if t:
            a, b = first.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64), np.array(b_ids[k], np.int64)
            k += 1
            want = np.frombuffer((" " + t).encode(), np.uint8)
            if all(int(w.lengths[i].sum()) == len(want) and (_joined(i, w) == want).all() for i, w in ((a, v.a), (b, v.b))):
                pair = (a, b)
        out.append(pair)
    return out


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_span: np.ndarray, b_span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions (in A's and in B's tokens) of all tokens that end together.

    ``a_ends`` and ``b_ends`` hold the byte at which every token ends, text after text; row i of the spans is lane i's part
    of them. Links come back in order of A's tokens.
    """
    live = np.flatnonzero((a_span[:, 0] < a_span[:, 1]) & (b_span[:, 0] < b_span[:, 1]))
    p, q = a_span[live, 0].copy(), b_span[live, 0].copy()
    p_end, q_end = a_span[live, 1], b_span[live, 1]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    while len(p):
        x, y = a_ends[p], b_ends[q]
        meet = x == y
        if meet.any():
            links.append((p[meet], q[meet]))
        p = p + (x <= y)
        q = q + (y <= x)
        on = (p < p_end) & (q < q_end)
        if not on.all():
            p, q, p_end, q_end = p[on], q[on], p_end[on], q_end[on]
    if not links:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*links))
    order = np.argsort(i)
    return i[order], j[order]


def _lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_bound: np.ndarray, b_bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of at most ``LANE_TOKENS`` of A's tokens, with the tokens of B that end in the same bytes."""
    starts = [np.arange(s, e, LANE_TOKENS) for s, e in zip(a_bound[:-1], a_bound[1:])]
    text = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
    begin = np.concatenate(starts) if starts else np.empty(0, np.int64)
    end = np.minimum(begin + LANE_TOKENS, a_bound[text + 1])
    b_begin = np.where(begin == a_bound[text], b_bound[text], np.searchsorted(b_ends, a_ends[np.maximum(begin - 1, 0)], "right"))
    b_end = np.searchsorted(b_ends, a_ends[end - 1], "right") if len(end) else end
    return np.column_stack([begin, end]), np.column_stack([b_begin, b_end])


def _printed(a_ids: np.ndarray, b_ids: np.ndarray, i: np.ndarray, j: np.ndarray, a_bound: np.ndarray, b_bound: np.ndarray, v: SimpleNamespace) -> tuple[bytes, np.ndarray]:
    """The groups of all texts as one line of bytes (``a1,a2|b1;a3|b2``), and where each text's part begins."""
    n_a, n_b = len(a_ids), len(b_ids)
    # a token's line number: its own side's tokens before it and those of the other side in earlier groups (for B: up to its own)
    links_before = lambda n, at: np.cumsum(np.bincount(at + 1, minlength=n + 1))[:n]
    at_a = np.arange(n_a) + np.append(0, j + 1)[links_before(n_a, i)]
    at_b = np.arange(n_b) + np.append(i, n_a - 1)[links_before(n_b, j)] + 1
    width = v.a.digits.shape[1] + 1
    lines = np.zeros((n_a + n_b, width), np.uint8)
    lines[at_a, :-1], lines[at_b, :-1] = v.a.digits[a_ids], v.b.digits[b_ids]
    lines[:, -1] = COMMA
    lines[at_a[i], -1], lines[at_b[j], -1] = BAR, SEMICOLON
    lines[(a_bound + b_bound)[1:][np.diff(a_bound) > 0] - 1, -1] = 0  # nothing after a text's last token
    shown = lines != 0
    return lines[shown].tobytes(), np.append(0, np.cumsum(shown.sum(1)))[a_bound + b_bound]


def align_batch(texts: list[str], v: SimpleNamespace) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, pair numbers of the links, groups) of each text."""
    ids = encode_both(texts, v)
    a_ids, b_ids = (np.concatenate([x[k] for x in ids]) if ids else np.empty(0, np.int64) for k in (0, 1))
    a_bound, b_bound = (np.append(0, np.cumsum([len(x[k]) for x in ids])).astype(np.int64) for k in (0, 1))
    # ends count on over the texts, so they rise throughout; both sides of a text have the same bytes
    a_ends, b_ends = np.cumsum(v.a.lengths[a_ids]), np.cumsum(v.b.lengths[b_ids])
    i, j = lockstep(a_ends, b_ends, *_lanes(a_ends, b_ends, a_bound, b_bound))
    pairs = np.searchsorted(v.pairs, a_ids[i] * len(v.b.lengths) + b_ids[j]).astype("<u4")
    line, place = _printed(a_ids, b_ids, i, j, a_bound, b_bound, v)
    link_bound = np.searchsorted(i, a_bound)
    for k in range(len(texts)):
        x, y = link_bound[k], link_bound[k + 1]
        yield a_bound[k + 1] - a_bound[k], b_bound[k + 1] - b_bound[k], y - x, pairs[x:y].tobytes(), line[place[k] : place[k + 1]].decode()


def _steps(texts: list[str | None]) -> Iterator[list[str]]:
    step, size = [], 0
    for t in texts:
        step.append(t or "")
        size += len(step[-1])
        if size >= STEP_BYTES:
            yield step
            step, size = [], 0
    if step:
        yield step


def align_tokens(customers: DataFrame, byte_vocabulary: str, piece_model: str, text: str = "address", as_column: str = "alignment") -> DataFrame:
    """``customers`` with how two tokenizers cut their texts: struct of n_a, n_b, n_groups, n_links, groups and links.

    A is a byte-level BPE (a JSON definition, whose merges must be in the order of their ids) over a space and the text, B a piece model that adds the space itself.
    Bytes at which a token of A and one of B end cut both into groups, ``a1,a2|b1;a3|b2,b3``. Every token has a byte at least,
    so each cut links one token of A with one of B; ``links`` are these pairs as little-endian unsigned 32-bit places in
    :func:`linkable_pairs`. Null and empty texts, and texts that a tokenizer changes, have no tokens. All columns are kept,
    one called ``as_column`` is replaced; equal rows stay.
    """
    held = customers.sparkSession.sparkContext.broadcast(load_vocabularies(byte_vocabulary, piece_model))  # a few MB, fixed by the files

    @F.arrow_udf("struct<n_a: long, n_b: long, n_groups: long, n_links: long, groups: string, links: binary>")
    def align(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = held.value
        for batch in batches:
            rows = [r for step in _steps(batch.to_pylist()) for r in align_batch(step, v)]
            n_a, n_b, n, links, groups = zip(*rows) if rows else [()] * 5
            counts = [pa.array([int(x) for x in c], pa.int64()) for c in (n_a, n_b, n, n)]
            yield pa.StructArray.from_arrays([*counts, pa.array(groups, pa.string()), pa.array(links, pa.binary())], names=["n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return customers.withColumn(as_column, align(F.col(text)))


def with_link_counts(aligned: DataFrame, byte_vocabulary: str, piece_model: str, links: str = "links", as_column: str = "linked") -> DataFrame:
    """``aligned`` with what its links are worth in all texts: struct of n_best and count_sum.

    A pair's count is the number of links that hold it in the whole table. ``count_sum`` adds the counts of a row's links,
    ``n_best`` counts its links whose count is the highest of their B id, ties included. ``aligned`` is written to the shared
    folder first, so that nothing is encoded twice. Counts are summed in each partition and then by pair: at most one row a
    linkable pair, a bound set by the vocabularies, and so may be gathered and broadcast. A null counts as no links.
    """
    spark = aligned.sparkSession
    v = load_vocabularies(byte_vocabulary, piece_model)
    n_pairs, b_of = len(v.pairs), v.pairs % len(v.b.lengths)
    rows = stored(aligned, "alignments")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                if cell:
                    pair, n = np.unique(np.frombuffer(cell, "<u4"), return_counts=True)
                    total[pair] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["pair", "n"])

    sums = rows.select(links).mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(n_pairs, np.int64)
    count[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    highest = np.zeros(len(v.b.lengths), np.int64)
    np.maximum.at(highest, b_of, count)
    held = spark.sparkContext.broadcast((count, count == highest[b_of]))

    @F.arrow_udf("struct<n_best: long, count_sum: long>")
    def worth(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts, best = held.value
        for batch in batches:
            cells = [np.frombuffer(c or b"", "<u4") for c in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([int(best[c].sum()) for c in cells], pa.int64()), pa.array([int(counts[c].sum()) for c in cells], pa.int64())], names=["n_best", "count_sum"])

    return rows.withColumn(as_column, worth(F.col(links)))
