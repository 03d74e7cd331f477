"""Byte-level BPE against the tiktoken library, a plain merge loop and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tests.llm import corpora
from tidemark.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def judge(ranks):
    return tiktoken.Encoding("judge", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(judge, text):
    ids = judge.encode_ordinary(text or "")
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def awkward(rng):
    letters = "abcde f\u00e9z\u6f22 1\U0001f600'"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(3000)]
    out += ["a" * n for n in (1, 2, 3, 63, 64, 65, 66, 5000)] + ["\u00e9" * 33, " " * 3000 + "x", "\n\n \t x", "it's they'LL", "\x1c\x85\xa0 x", "12345 \u00bd", "<|endoftext|>"]
    return out


def test_ids_equal_the_library(ranks, judge):
    texts = awkward(random.Random(2))
    vocabulary = byte_bpe.Vocabulary(ranks, PATTERN)
    for _ in range(2):  # new pieces, then remembered ones
        assert [list(ids) for ids in vocabulary.encode(texts)] == [judge.encode_ordinary(t) for t in texts]


def test_forgetting_changes_nothing(ranks, judge, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    monkeypatch.setattr(byte_bpe, "BLOCK", 50)
    texts = awkward(random.Random(3))[:300]
    assert [list(ids) for ids in byte_bpe.Vocabulary(ranks, PATTERN).encode(texts)] == [judge.encode_ordinary(t) for t in texts]


def plain(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        joins = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not joins:
            return [ranks[p] for p in parts]
        _, i = min(joins)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(4))
def test_trees_equal_a_plain_loop(seed):
    """Small vocabularies where many joins have the same parts, one tree at a time and in step."""
    rng = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    while len(tokens) < 300:
        new = rng.choice(tokens[97:99] + tokens[256:]) + rng.choice(tokens[97:99] + tokens[256:])
        if new not in tokens:
            tokens.append(new)
    order = list(range(300))
    rng.shuffle(order)
    ranks = dict(zip(tokens, order, strict=True))
    joins = byte_bpe.Joins(ranks)
    for leaves in (1, 2, 4, 8, 16, 32):
        pieces = ["".join(rng.choice("aab" if seed % 2 else "ab") for _ in range(rng.randint(2, leaves + 1))).encode() for _ in range(200)]
        want = [plain(p, ranks) for p in pieces]
        assert [byte_bpe.merged(p, ranks) for p in pieces] == want
        assert list(map(list, byte_bpe.merged_in_step(pieces, leaves, joins))) == want


def test_documents_of_all_kinds(spark, judge):
    rows = {}
    got = byte_bpe.token_digests(corpora.documents(spark), PATH, PATTERN).collect()
    for r in corpora.rows():
        rows.setdefault(r[0], []).append(digests(judge, r[1]))
    assert len(got) == len(corpora.rows())
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in rows.items()}
    assert byte_bpe.token_digests(corpora.empty(spark), PATH, PATTERN).count() == 0


def test_ids_decode_to_the_text_and_names_do_not_clash(spark, judge):
    docs = corpora.documents(spark).withColumnRenamed("n_words", "token_ids").withColumnRenamed("found", "decoded")
    out = byte_bpe.with_decoded(byte_bpe.with_token_ids(docs, PATH, PATTERN), PATH, "_token_ids")
    assert out.columns == [*docs.columns, "_token_ids", "_decoded"]
    rows = out.collect()
    assert len(rows) == len(corpora.rows())
    for r in rows:
        assert bytes(r["_decoded"]).decode() == (r.text or "") and list(r["_token_ids"]) == judge.encode_ordinary(r.text or "")
    nulls = byte_bpe.with_decoded(spark.createDataFrame([(None,), ([],)], "token_ids array<int>"), PATH).collect()
    assert [r.decoded for r in nulls] == [None, b""]


def test_a_vocabulary_is_checked(tmp_path):
    (tmp_path / "few").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="missing"):
        byte_bpe.read_ranks(str(tmp_path / "few"))
    with pytest.raises(ValueError, match="too many"):
        byte_bpe.read_ranks(PATH, most=1000)
