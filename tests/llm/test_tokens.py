"""Byte-level BPE and tokenizer alignment against the libraries and brute force."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from fleetspan.llm import bytepairs, crosswalk, queries

RANKS, JSON, MODEL = (public_tokenizers.path(f) for f in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
AWKWARD = [None, "", " ", "\n\n", "a", "'", "'s", "x's 'll''re", "  'tis\t's", "<|endoftext|> and <s></s><unk>", "日本語 é́ ﬁ", "a▁b", "\U0001f600 \x00\x1c", "a" * 3000, " " * 3000 + "x", "'" * 999 + "s", "tail   "]
SCHEMA = "customer_id string, address string, tokens int, links int, alignment string"


@pytest.fixture(scope="module")
def vocabulary():
    return bytepairs.load_vocabulary(RANKS)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_that_of_the_files():
    assert bytepairs.PATTERN == public_tokenizers.PATTERN


@pytest.mark.parametrize("step", [bytepairs.STEP_CHARS, 5, 64])
def test_pieces_and_merges_against_the_library(vocabulary, library, monkeypatch, step):
    monkeypatch.setattr(bytepairs, "STEP_CHARS", step)
    rng = random.Random(step)
    symbols = list("''''sstmdrevl  \n\t\r\x85aZéß日1½Ⅷ!. 　\U0001f600<|") + ["'ll", "'re"]
    texts = ["".join(rng.choices(symbols, k=rng.randint(0, 40))) for _ in range(4000 if step > 1000 else 400)] + [t or "" for t in AWKWARD[:-4]]
    for text, (ids, offsets) in zip(texts, bytepairs.encode_texts([t.encode() for t in texts], vocabulary), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert bytepairs.decoded(ids, offsets, vocabulary) == text.encode()
        assert offsets.tolist() == np.cumsum([0, *vocabulary.lengths[ids]])[: len(ids)].tolist()


def test_every_code_point_is_in_its_class(vocabulary, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][:: 7]
    texts = ["".join(f"x{chr(c)} 1{chr(c)}" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    for text, (ids, _) in zip(texts, bytepairs.encode_texts([t.encode() for t in texts], vocabulary)):
        assert ids.tolist() == library.encode_ordinary(text)


def test_long_pieces_use_the_heap(vocabulary, monkeypatch):
    rng = random.Random(1)
    pieces = ["".join(rng.choices("abehnort", k=rng.randint(2, 60))).encode() for _ in range(500)]
    plain = [bytepairs.merged(p, vocabulary.ranks, vocabulary.joins) for p in pieces]
    monkeypatch.setattr(bytepairs, "SHORT", 0)
    assert plain == [bytepairs.merged(p, vocabulary.ranks, vocabulary.joins) for p in pieces]


def test_token_columns(spark, library):
    rows = [(f"CUS-{i}", t, 1, 2, "x") for i, t in enumerate([*AWKWARD, "again", "again"])]
    df = spark.createDataFrame(rows, SCHEMA)
    out = bytepairs.with_decoded(bytepairs.with_tokens(df, RANKS), RANKS).collect()
    assert len(out) == len(rows)
    for r in out:
        assert np.frombuffer(r["tokens"]["ids"], "<u4").tolist() == library.encode_ordinary(r["address"] or "") and r["decoded"] == (r["address"] or "").encode() and (r["links"], r["alignment"]) == (2, "x")
    assert bytepairs.with_tokens(df.limit(0), RANKS).count() == 0


def test_bpe_query(spark, sf, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.QUERIES["op12_byte_bpe"](spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = np.array(library.encode_ordinary(docs[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())


def aligned_by_hand(text, tools, a_bytes, b_bytes):
    """(n_a, n_b, n_groups, linked id pairs, groups) by the definition."""
    a = tools[0].encode(" " + text, add_special_tokens=False).ids if text else []
    b = tools[1].encode(text) if text else []
    want = (" " + (text or "")).encode()
    if not text or b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
        return 0, 0, 0, [], ""
    a_ends, b_ends = (np.cumsum([len(w[i]) for i in ids]).tolist() for ids, w in ((a, a_bytes), (b, b_bytes)))
    cuts = sorted(set(a_ends) & set(b_ends))
    group_of = lambda ids, ends: [",".join(str(i) for i in g) for g in np.split(ids, np.searchsorted(ends, cuts, "right"))[:-1]]
    groups = ["|".join(x) for x in zip(group_of(a, a_ends), group_of(b, b_ends))]
    at_a, at_b = ({e: i for i, e in zip(ids, ends)} for ids, ends in ((a, a_ends), (b, b_ends)))
    links = [(at_a[c], at_b[c]) for c in cuts]
    return len(a), len(b), len(cuts), links, ";".join(groups)


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(JSON)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters = crosswalk._byte_letters()
    a = {i: "<|endoftext|>".encode() if t == "<|endoftext|>" else bytes(letters[c] for c in t) for t, i in first.get_vocab().items()}
    b = {i: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in range(second.get_piece_size()) for p in [second.id_to_piece(i)]}
    return (first, second), a, b


@pytest.mark.parametrize("lane", [crosswalk.LANE_TOKENS, 3])
def test_alignment_against_brute_force(monkeypatch, tools, lane):
    monkeypatch.setattr(crosswalk, "LANE_TOKENS", lane)
    v = crosswalk.load_vocabularies(JSON, MODEL)
    rng = random.Random(lane)
    texts = [t or "" for t in AWKWARD] + [" ".join(rng.choices("route depot parcel's 12 naïve 日本 <s> \n x▁y the of and".split(" "), k=rng.randint(1, 60))) for _ in range(80)]
    for text, r in zip(texts, crosswalk.align_batch(texts, v), strict=True):
        codes = v.pairs[np.frombuffer(r[3], "<u4")]
        pairs = [(int(c) // len(v.b.lengths), int(c) % len(v.b.lengths)) for c in codes]
        assert (r[0], r[1], r[2], pairs, r[4]) == aligned_by_hand(text, *tools), repr(text)


def test_crosswalk_query(spark, sf, tools):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    by_hand = {k: aligned_by_hand(t, *tools) for k, t in docs.items()}
    count = {}
    for *_, links, _ in by_hand.values():
        for pair in links:
            count[pair] = count.get(pair, 0) + 1
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    out = queries.QUERIES["op13_token_crosswalk"](spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        a, b, n, links, groups = by_hand[r["doc_id"]]
        sha = hashlib.sha256(groups.encode()).hexdigest() if a else ""
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == (a, b, n, len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), sha)


def test_crosswalk_columns(spark):
    df = spark.createDataFrame([(f"CUS-{i}", t, 1, 2, "x") for i, t in enumerate([None, "", "depot", "depot", "a▁b"])], SCHEMA)
    aligned = crosswalk.align_tokens(df.drop("alignment"), JSON, MODEL)
    out = {r["customer_id"]: r for r in crosswalk.with_link_counts(aligned.withColumn("links", aligned["alignment.links"]), JSON, MODEL).collect()}
    assert len(out) == 5 and out["CUS-0"]["alignment"]["n_a"] == out["CUS-1"]["alignment"]["n_a"] == out["CUS-4"]["alignment"]["n_a"] == 0 and out["CUS-0"]["linked"]["count_sum"] == 0
    assert out["CUS-2"]["linked"]["count_sum"] == 2 * out["CUS-2"]["alignment"]["n_links"] == out["CUS-3"]["linked"]["count_sum"]
    assert crosswalk.with_link_counts(crosswalk.align_tokens(df.limit(0), JSON, MODEL).select("alignment.links"), JSON, MODEL).count() == 0
