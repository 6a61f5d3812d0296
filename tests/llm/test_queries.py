"""The registered queries on a whole small table, and the pipeline stage by stage."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_operators import WORD, brute_links, brute_removed, brute_secrets, brute_taken, groups_of, sets

import corpus_pipeline
from lumensift.llm import oracle, queries, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.sql(oracle.SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want.project(", ".join(columns)).fetchall())


def test_names():
    own = registry.queries()
    assert {n.split("_")[0] for n in own} == {f"op{n}" for n in range(1, 11)} | {"pipeline"}


def test_queries_by_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    removed = {i: rest for (i, *rest) in brute_removed(docs, 200)}
    assert {r.doc_id: [r.n_bytes, r.n_removed, r.n_spans] for r in queries.op2_suffix_dedup(spark, SF).collect()} == {i: r[:3] for i, r in removed.items()}
    assert {r.doc_id: r.spans for r in queries.op5_secret_scan(spark, SF).collect()} == {i: brute_secrets(t) for i, t, _ in docs}
    own = {i: sets(t, 2) for i, t, _ in docs}
    assert {r.doc_id: r.component_id for r in queries.op6_minhash(spark, SF).collect()} == groups_of(own, 80)


def test_mixing_query_by_brute_force(spark):
    """Which documents the mix takes, and how much of each: by a walk through each source in order of the keys."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    text_hash = F.xxhash64("text")
    key = F.xxhash64(F.lit(20_240_607), F.coalesce("doc_id", F.lit(-1)), text_hash)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", key.alias("key"), text_hash.alias("hash"), "text", "source").collect()
    want, taken = brute_taken([(r.doc_id, r.key, r.hash, len(WORD.findall(r.text or "")), r.source) for r in docs])
    source = {r.doc_id: r.source for r in docs}
    got = queries.op1_mixing(spark, sf).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter({(i, size, t): n for (i, _, _, size, _, t), n in taken.items()})
    assert all(abs(r.target - want[source[r.doc_id]]) < 1e-6 for r in got)


def test_vectors_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op4_vector_dedup(spark, sf).collect()}
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        fits = r.label is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)
        if fits:
            groups.setdefault((r.label, len(r.embedding)), []).append((r.vec_id, r.embedding))
        else:
            assert got[r.vec_id] == (0, r.vec_id, True)
    for own in groups.values():
        for vec_id, (links, component) in brute_links(own).items():
            assert got[vec_id] == (links, component, vec_id == component)


def test_bpe_query_by_brute_force(spark):
    import hashlib

    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    tok = Tokenizer.from_file(queries.tokenizer())
    tok.no_truncation()
    tok.no_padding()
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_bpe(spark, sf).collect()) == want


def test_chat_query_by_brute_force(spark):
    import hashlib

    sf = "/root/testdata/sf0.01"
    own = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        own.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    want = {}
    for conv, turns in own.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        want[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = queries.op10_chat_format(spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)


def test_fit_is_a_minimum():
    """The weights minimise the loss of noisy-or bags: the plain loss, bag by bag, only grows around them."""
    from lumensift.llm import toxicity

    rng = np.random.default_rng(1)
    bags = [[set(rng.choice(12, rng.integers(1, 5), replace=False).tolist()) for _ in range(rng.integers(1, 6))] for _ in range(400)]
    labels = np.array([float(any({0, 1} & s for s in b) and rng.random() < 0.9) for b in bags])
    flat = [(n, s) for n, b in enumerate(bags) for s in b]
    pairs = np.array([(i, w) for i, (_, s) in enumerate(flat) for w in sorted(s)])
    sizes = np.array([len(b) for b in bags])
    weights, bias = toxicity.fit(np.array([n for n, _ in flat]), pairs[:, 0], pairs[:, 1], sizes, labels, 12, steps=3000)

    def loss(theta):
        out = toxicity.PENALTY / 12 * float((theta[:-1] ** 2).sum())
        for b, y in zip(bags, labels, strict=True):
            clean = 1.0
            for s in b:
                clean *= 1 - 1 / (1 + np.exp(-(theta[-1] + sum(theta[w] for w in s))))
            out -= (np.log(max(1 - clean, 1e-12)) if y else np.log(max(clean, 1e-12))) / len(bags)
        return out

    best = np.append(weights, bias)
    least = loss(best)
    assert all(loss(best + rng.normal(scale=s, size=13)) > least - 1e-4 for s in (0.02, 0.1, 0.5) for _ in range(15))
    assert weights[:2].min() > 3 * np.abs(weights[2:]).max()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.predicted == 1).sum() > 0.9 and hit / (got.toxic == 1).sum() > 0.8


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = docs.collect()
        assert name == "bpe" or docs.columns == columns
    before = spark.read.parquet(f"{SF}/documents.parquet").collect()
    scores = {r.doc_id: r.predicted for r in queries.op3_toxicity(spark, SF).collect()}
    stayed = {r.doc_id for r in kept["toxicity"]}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert sum(i in stayed for i in clean) >= 0.97 * len(clean) and sum(scores.values()) < 0.2 * len(before)
    first = {}
    for r in sorted(kept["toxicity"], key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert {r.doc_id for r in kept["exact_dedup"]} == set(first.values())
    own = {r.doc_id: sets(r.text, 5) for r in kept["exact_dedup"]}
    assert {r.doc_id for r in kept["minhash_near_dedup"]} == {i for i, c in groups_of(own, 80).items() if i == c}
    words = sum(len(WORD.findall(r.text)) for r in kept["minhash_near_dedup"])
    assert abs(sum(len(WORD.findall(r.text)) for r in kept["mixing"]) - 1.5 * words) <= 20
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer())
    tok.no_truncation()
    want = Counter((r.doc_id, np.array(tok.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()) for r in kept["mixing"])
    assert Counter((r.doc_id, bytes(r.ids)) for r in kept["bpe"]) == want
    assert Counter((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()) == want
