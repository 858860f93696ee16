"""Sharding, token output, mixing and the pipeline."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from flowlens.llm import decontaminate, mixing, rules, sharding, simhash, token_output as tokens
from test_minhash import plain_groups
from tests_llm_data import WORD, prose


def test_shards_are_even_gapless_and_shuffled(spark, odd, nothing):
    docs = spark.createDataFrame([(i, prose(i, 5 + i % 50), i) for i in range(1003)], "doc_id long, text string, slot int")
    placed = sharding.shuffle_into_shards(docs, shards=16, bucket_bytes=20_000)
    rows = placed.collect()
    assert placed.columns == ["doc_id", "text", "shard", "slot"]
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 1003
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r.doc_id, r.text) for r in docs.collect())
    ids = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.12
    again = sharding.shuffle_into_shards(docs.repartition(7), shards=16, bucket_bytes=20_000).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in rows)
    few = sharding.shuffle_into_shards(odd.limit(5), shards=16).collect()
    assert len(few) == 5 and {r.slot for r in few} == {0}
    copies = spark.createDataFrame([(None, None)] * 300, "doc_id long, text string")  # one bucket
    sizes = collections.Counter(r.shard for r in sharding.shuffle_into_shards(copies, shards=7).collect())
    assert sum(sizes.values()) == 300 and set(sizes.values()) <= {42, 43}
    assert sharding.shuffle_into_shards(nothing).count() == 0


def test_written_shards_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 9)) for i in range(50)], "doc_id long, text string")
    sharding.write_shards(sharding.shuffle_into_shards(docs, shards=4), str(tmp_path / "out"))
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(50))


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_permutation(size):
    out = tokens.permuted(np.arange(size), size, 3)
    assert sorted(out.tolist()) == list(range(size))
    if size > 60:
        assert (out != tokens.permuted(np.arange(size), size, 4)).any() and abs(np.corrcoef(out, np.arange(size))[0, 1]) < 0.3


def test_tokens_round_trip(spark, odd, nothing, tmp_path):
    layout = tokens.Layout(length=64, per_shard=50)
    records = tokens.training_order(odd, layout).cache()
    rows = records.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    plain = tokens.Tokenizer(layout.ranks())
    want, got = collections.Counter(), collections.defaultdict(dict)
    texts = [r.text for r in odd.collect() if r.text]
    for text in texts:
        ids = [*plain.coder.encode_ordinary(text), plain.end]
        assert np.frombuffer(plain.encode(text), plain.dtype).tolist() == ids[:-1]
        assert plain.coder.decode(ids[:-1]) == text
        for at in range(0, len(ids), 64):
            want[tuple(ids[at : at + 64])] += 1
    have = collections.Counter()
    for r in rows:
        ids = np.frombuffer(r.tokens, "<u2")
        assert len(ids) == 64 and (ids[r.n_tokens :] == plain.end).all()
        assert (r.shard, r.offset) == (r.slot // 50, r.slot % 50 * 128)
        have[tuple(ids[: r.n_tokens].tolist())] += 1
        got[r.slot] = ids
    assert have == want
    folder = str(tmp_path / "shards")
    manifest = sorted(tokens.write_shards(records, folder).collect())
    assert [m.shard for m in manifest] == list(range(len(manifest))) and sum(m.n_sequences for m in manifest) == len(rows)
    read = tokens.read_slots(folder, layout, 37, 155)
    assert all((read[i] == got[37 + i]).all() for i in range(155 - 37))
    assert tokens.training_order(nothing, layout).count() == 0


def plain_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, bound = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in bound]
        left = total - sum(3 * sizes[s] for s in bound)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in bound}
        bound |= over


def test_mix_meets_its_targets(spark, odd, nothing):
    rng = np.random.default_rng(2)
    names = ["a", "b", "c", "d", "e", None, ""]
    rows = [(i, prose(i, int(rng.integers(1, 60))), names[min(6, int(rng.exponential(1.2)))], i) for i in range(1500)]
    rows += [(5000 + i, None, "a", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_table(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    sizes, taken, shards = collections.Counter(), collections.Counter(), collections.Counter()
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert r["size"] == len(WORD.findall(text[r.doc_id] or "")) and len(r.copies) <= 3
        assert [c.turn for c in r.copies] == list(range(1, len(r.copies) + 1))
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * len(r.copies)
        shards.update(c.shard for c in r.copies)
    want = plain_targets(sizes)
    assert {r.source: r.target for r in got} == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 30 for s in want)
    assert set(shards) == set(range(16)) and min(shards.values()) > 0.6 * max(shards.values())
    again = mixing.mix_table(docs.repartition(5)).collect()
    assert {(r.doc_id, str(r.copies)) for r in again} == {(r.doc_id, str(r.copies)) for r in got}
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(r.copies) for r in got)
    assert mixing.mix_table(odd).count() == odd.count() and mixing.mixture(odd).columns == odd.columns
    assert mixing.mix_table(nothing).count() == 0 and mixing.mixture(nothing).count() == 0


def test_tree_splits_items_evenly(spark):
    items = spark.createDataFrame([(f"s{i % 3}", i, 1) for i in range(1000)], "source string, cell int, turn int")
    got = mixing.split_tree(items, 16).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == 1000 and sorted(counts) == list(range(16)) and max(counts.values()) - min(counts.values()) <= 4


def test_pipeline_matches_plain_versions(spark, tmp_path):
    """Every stage after the language model, whose decisions are read from its output, is held against a plain version."""
    import pathlib

    sf = "/root/testdata/sf0.001"
    if not pathlib.Path(sf).exists():
        pytest.skip("needs the given tables")
    docs, outs = spark.read.parquet(f"{sf}/documents.parquet"), {}
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outs[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == first.columns
    before = {r.doc_id for r in first.collect()}
    lang = {r.doc_id: r.text for r in outs["language"]}
    assert len(lang) >= 0.99 * len(before)
    ids = sorted(lang)
    groups = plain_groups([lang[i] for i in ids])
    kept = sorted({g: min(i for i, x in zip(ids, groups, strict=True) if x == g) for g in groups}.values())
    assert sorted(r.doc_id for r in outs["near_duplicates"]) == kept
    marks = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaked(text: str) -> bool:
        w = re.findall(r"\w+", text.lower())
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for m in marks:
            covered = {i + k for i in range(len(m) - 4) if tuple(m[i : i + 5]) in grams for k in range(5)}
            if len(covered) >= 0.5 * len(m):
                return True
        return False

    clean = [i for i in kept if not leaked(lang[i])]
    assert sorted(r.doc_id for r in outs["benchmark_leaks"]) == clean
    sources = {r.doc_id: r.source for r in outs["benchmark_leaks"]}
    sizes, took = collections.Counter(), collections.Counter()
    for i, s in sources.items():
        sizes[s] += len(WORD.findall(lang[i]))
    for r in outs["mix"]:
        took[r.source] += len(WORD.findall(r.text))
    longest = collections.Counter()
    for i, s in sources.items():
        longest[s] = max(longest[s], len(WORD.findall(lang[i])))
    for s, target in plain_targets(sizes).items():
        assert abs(took[s] - target) <= longest[s]
    coder = tokens.Tokenizer(tokens.Layout().ranks())
    n = sum(-(-(len(coder.encode(r.text)) // 2 + 1) // 512) for r in outs["mix"])
    assert sorted(r.slot for r in outs["tokens"]) == list(range(n))


def test_crc(spark):
    from pyspark.sql import functions as F

    from flowlens.llm.common import whole_text

    row = spark.createDataFrame([("é",), (None,)], "text string").select(F.crc32(whole_text()).alias("c"), sharding.size_of().alias("s")).collect()
    assert [(r.c, r.s) for r in row] == [(zlib.crc32("é".encode()), 3), (0, 1)]


def test_columns_of_any_name_pass_through(spark):
    names = ["b", "n", "start", "__b", "__n", "__start", "__leak", "__kept", "__row", "__rules"]
    docs = spark.createDataFrame(
        [(i, prose(i % 3, 60), *range(i, i + len(names))) for i in range(9)], ", ".join(["doc_id long, text string", *[f"{c} int" for c in names]])
    )
    benchmark = spark.createDataFrame([(1, prose(2, 60))], "item_id long, text string")

    def held(got, keys) -> bool:
        rows = got.collect()
        return len(rows) > 0 and all([r[c] for c in names] == list(range(r.doc_id, r.doc_id + len(names))) for r in rows) and set(got.columns) == {*docs.columns, *keys}

    assert held(sharding.shuffle_into_shards(docs, shards=4), ["shard", "slot"])
    assert held(simhash.deduplicate(docs), [])
    assert held(decontaminate.decontaminate(docs, benchmark), []) and decontaminate.decontaminate(docs, benchmark).count() == 6
    assert held(rules.quality_rules(docs), ["rules"])
