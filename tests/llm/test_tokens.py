import base64
import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st  # noqa: I001

from strandloom.llm import boundary_cuts as c, bpe, packing as p, token_ids as t

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.TOKENIZERS), reason="no vocabulary files")


@pytest.fixture(scope="module")
def official():
    tiktoken = pytest.importorskip("tiktoken")
    with open(os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text("ab th<|endoftext|>\n\t .'sé中🙂", max_size=300)))
def test_same_ids_as_the_public_library(official, text):
    assert bpe.encoder().encode(text) == official.encode_ordinary(text)


def test_runs_and_long_stretches(official):
    e = bpe.encoder()
    for text in ("a" * 1001, "ab" * 700, " " * 500 + "x", "\n" * 77, "É" * 300, "ACDEFGHIKL" * 3000):
        assert e.encode(text) == official.encode_ordinary(text)


def test_documents(spark, small, official):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.ids for r in t.p8_ids(spark, small).collect()}
    assert got == {r.doc_id: official.encode_ordinary(r.text) if isinstance(r.text, str) else [] for r in docs.itertuples()}


def test_null_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "hello world", 7), (2, "<|endoftext|>", 8)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, len(r.ids)) for r in t.token_ids(df).collect())
    assert got == [(0, 2), (1, 0), (1, 0), (2, 7)]
    assert t.token_ids(df.limit(0)).count() == 0


def check_packed(items, got, capacity, segments):
    total = got.groupby("container_id").n_tokens.agg(["sum", "count"])
    assert total["sum"].max() <= capacity and total["count"].max() <= segments
    assert not got.duplicated(["container_id", "position"]).any()
    assert (got.groupby("container_id").position.max() + 1 == total["count"]).all()
    whole = got.groupby("doc_id").agg(n=("n_tokens", "sum"), pieces=("piece_no", "count"))
    for key, n in items:
        assert whole.loc[key].n == n and whole.loc[key].pieces == max(1, -(-n // capacity))


@pytest.mark.parametrize("bucket,segments", [(20_000, 256), (100, 256), (100, 8)])
def test_containers(spark, bucket, segments):
    r = np.random.default_rng(5)
    items = [(i, int(n)) for i, n in enumerate(np.r_[r.geometric(1 / 300, 700), [0, 0, 5000, 2048, 2049]])]
    got = p.containers(spark.createDataFrame(items, "doc_id long, n_tokens long"), max_segments=segments, bucket_items=bucket).toPandas()
    check_packed(items, got, 2048, segments)
    if segments == 256:
        assert got.n_tokens.sum() / (got.container_id.nunique() * 2048) > 0.97


def test_containers_of_unknown_sizes(spark):
    got = p.containers(spark.createDataFrame([(1, None), (None, 5), (1, 5), (1, 5)], "doc_id long, n_tokens long"))
    assert sorted(r.n_tokens for r in got.collect()) == [0, 5, 5, 5] and got.select("container_id").distinct().count() == 1


def test_loss_limits_the_containers(spark):
    """Texts without a prompt fill containers up to the loss limit only; those with one fill them up. A limit that does not
    bind gives other containers."""
    rows = [(i, 512, 0 if i % 2 else 200) for i in range(400)]
    packed = lambda rows, **limits: p.containers(spark.createDataFrame(rows, "doc_id long, n_tokens long, n_prompt long"), **({"max_loss": p.MAX_LOSS, "piece": p.PIECE} | limits)).toPandas()
    got = packed(rows)
    assert got.groupby("container_id").loss.sum().max() <= p.MAX_LOSS and got.groupby("container_id").n_tokens.sum().max() <= 2048
    free = packed(rows, max_loss=None)
    assert free.groupby("container_id").loss.sum().max() > p.MAX_LOSS
    assert got.container_id.nunique() <= 1.05 * free.container_id.nunique()
    big = packed([(1, 5000, 100), (2, 2000, 0), (3, 30, 0)])
    assert big[big.doc_id == 1].sort_values("piece_no").n_tokens.tolist() == [512] * 9 + [392] and big[big.doc_id == 1].sort_values("piece_no").loss.tolist() == [412] + [512] * 8 + [392]
    alone = big[big.doc_id == 2].container_id.iloc[0]
    assert (big.container_id == alone).sum() == 1  # over the loss limit by itself, and still whole


def test_more_items_than_one_task_packs(spark):
    """The same fill on either side of the number of items a task takes."""
    r = np.random.default_rng(5)
    fill = []
    for n in (8_000, 24_000):
        items = [(i, int(x), int(x) // 3) for i, x in enumerate(np.minimum(r.geometric(1 / 300, n), 2048))]
        got = p.containers(spark.createDataFrame(items, "doc_id long, n_tokens long, n_prompt long"), bucket_items=10_000).toPandas()
        assert len(got) == n and got.doc_id.nunique() == n and got.groupby("container_id").n_tokens.sum().max() <= 2048
        fill.append(got.n_tokens.sum() / (got.container_id.nunique() * 2048))
    assert min(fill) > 0.98 and abs(fill[0] - fill[1]) < 0.01


def test_prompts():
    assert t.prompt_of("a\n\nb") == "a\n\n" and t.prompt_of("a\n \n ") == t.prompt_of("a\nb") == t.prompt_of("") == ""


def test_containers_of_nothing(spark):
    assert p.containers(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_pack_obeys_every_limit():
    r = np.random.default_rng(1)
    demand = np.c_[r.integers(0, 50, 400), np.ones(400), r.integers(0, 20, 400)].astype(float)
    at, pos = p.pack(demand, np.array([100.0, 5, 30]))
    for k in range(3):
        assert np.bincount(at, weights=demand[:, k]).max() <= (100, 5, 30)[k]


def test_sparse_table_against_a_scan():
    v = np.random.default_rng(2).integers(-1, 7, 400)
    table = c.Strongest(v)
    for low, high in [(0, 399), (5, 5), (17, 300), (100, 163), (398, 399)]:
        assert table.at(low, high) == max(range(low, high + 1), key=lambda i: (v[i], i))


@pytest.mark.parametrize("text", ["word " * 3000, "ACDEFG" * 2000, "中文字符，测试。" * 400, "🙂é" * 1500, "A line.\n\nAnother one, long; " * 300, "\n" * 3000 + "x y" * 600])
def test_pieces(text):
    e = bpe.encoder()
    got = c.pieces_of(text, e)
    ids = e.encode(text)
    assert got[0][0] == 0 and got[-1][1] == len(ids) and max(n for _, _, n, _ in got) <= 512
    for (a, b, _, own), (a2, b2, _, own2) in zip(got, got[1:]):
        assert a < a2 <= b < b2
        assert b - a2 <= 36 and (b - a2 >= 24 or "🙂" in text or "中" in text)
    joined = text.encode()
    assert joined.startswith(got[0][3].encode()) and joined.endswith(got[-1][3].encode()) and all(g[3] in text for g in got)


@pytest.mark.parametrize("text", ["it'sx don't 're  \n\n  ab12  cd's!!'s\t\tx " * 60, "  中文é🙂 a\u0301b " * 150, "\n \n\n" * 300 + "end", "'s'll'x" * 200, "a\n\n\n b \t\n1  c\n" * 90])
def test_counts_of_ranges_are_those_of_their_texts(text):
    e = bpe.encoder()
    parts = list(e.pieces(text))
    ids = [i for _, p in parts for i in p]
    raw, ends = text.encode(), np.cumsum([0, *[e.length[i] for i in ids]])
    whole = [i for i, at in enumerate(ends) if at == len(raw) or raw[at] & 0xC0 != 0x80]  # between characters
    encoded = lambda a, b: len(e.encode(raw[ends[a] : ends[b]].decode()))
    space = lambda a, b: raw[ends[a] : ends[b]].decode().isspace()
    count = c.range_counter(np.cumsum([0, *[len(p) for _, p in parts]]).tolist(), [p.isspace() for p, _ in parts], encoded, space)
    r = np.random.default_rng(3)
    for _ in range(400):
        a, b = sorted(r.choice(whole, 2, replace=False))
        assert count(int(a), int(b)) == encoded(a, b)


def test_paragraphs_before_sentences_before_words():
    e = bpe.encoder()
    for text, end in (("One two three. Four five,\n\nsix seven. " * 60, "\n"), ("One two three, four five. Six " * 80, "."), ("one two three " * 200, "e")):
        assert all(g[3].endswith(end) for g in c.pieces_of(text, e)[:-1]) or end == "e"


def test_short_null_and_empty_texts_give_no_pieces(spark, small):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "long one. " * 400)], "doc_id long, text string")
    assert {r.doc_id for r in c.split_oversized(df).collect()} == {4}
    docs = {r.doc_id: len(r.ids) for r in t.p8_ids(spark, small).collect()}
    assert {r.doc_id for r in c.p10_pieces(spark, small).select("doc_id").distinct().collect()} == {k for k, n in docs.items() if n > 512}
