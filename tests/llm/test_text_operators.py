"""Quality rules, language, quality scores: each text on its own."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from flowlens.llm import langid, quality, rules
from tests_llm_data import WORD, prose


def plain_counts(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    runs = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_rule_counts_match_a_plain_version(spark, odd, nothing):
    rows = rules.quality_rules(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        got = r.rules
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == plain_counts(r.text)
        failed = got.n_words < 50 or 100 * got.n_repeat_words > 50 * got.n_words
        assert got.base_failed == failed and not (failed and got.kept)
        if not r.text:
            assert got.verdict == "empty" and got.ratio is None
    assert rules.quality_rules(nothing).count() == 0
    tricky = "a b c a b c\nx\nx\n \n \ny d e f d e"
    assert rules.measure(tricky, rules.Bands(), zstandard.ZstdCompressor())[:5] == plain_counts(tricky)


def test_bands_reject_repetition_and_noise(spark):
    clean = prose(1, 900)
    noise = "".join(chr(33 + int(x)) + (" " if i % 9 == 0 else "") for i, x in enumerate(np.random.default_rng(1).integers(0, 90, 9000)))
    half = prose(2, 600) + " " + " ".join(f"again{i % 50}" for i in range(3000))
    table = spark.createDataFrame([(1, clean), (2, noise), (3, half), (4, "go " * 2000)], "doc_id long, text string")
    got = {r.doc_id: r.rules for r in rules.quality_rules(table).collect()}
    assert got[1].kept and got[1].verdict == "ok"
    assert got[2].verdict == "incompressible" and not got[2].kept
    assert got[3].verdict in ("chunks", "repetitive") and not got[3].kept
    assert got[4].base_failed and not got[4].kept


LANGS = {"aa": "bakolu mira tenso vaki", "bb": "schwer gruppe flucht zwang", "cc": "eau ouai peux tion"}


def language_rows(n: int) -> list[tuple]:
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        lang = sorted(LANGS)[i % 3]
        parts = LANGS[lang].split()
        words = ["".join(rng.choice(parts, 2)) for _ in range(int(rng.integers(3, 60)))]
        out.append((i, " ".join(words), lang if i % 17 else None))
    return out


def test_language_on_held_out_rows(spark, odd, nothing):
    rows = language_rows(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(langid.training_rows(docs))
    assert model.langs == sorted(LANGS)
    truth = {i: sorted(LANGS)[i % 3] for i, _, _ in rows}
    held = langid.identify(docs.join(langid.training_rows(docs), "doc_id", "left_anti"), model).collect()
    right = [r.language.lang_pred == truth[r.doc_id] for r in held]
    assert len(right) > 100 and sum(right) / len(right) > 0.98
    assert sum(r.language.rejected for r in held) <= 0.02 * len(held)
    for r in langid.identify(odd, model).collect():
        assert 0 <= r.language.score <= 1
        if not any(c.isalpha() for c in r.text or ""):
            assert r.language.lang_pred == "und" and r.language.rejected and r.language.score == 0
        else:
            assert r.language.lang_pred in LANGS
    assert langid.identify(nothing, model).count() == 0
    empty = langid.fit(nothing)
    assert {r.language.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_language_is_the_same_in_pieces(monkeypatch):
    text = prose(9, 400) + " " + "q" * 900
    whole = np.bincount(np.concatenate([langid.subwords(*p, 4096) for p in langid.pieces(text)]), minlength=4096)
    monkeypatch.setattr(langid, "PIECE", 97)
    cut = np.bincount(np.concatenate([langid.subwords(*p, 4096) for p in langid.pieces(text)]), minlength=4096)
    assert (whole == cut).all()


def test_quality_on_held_out_rows(spark, odd, nothing):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(900):
        good = i % 4 != 0
        text = prose(i, int(rng.integers(20, 120)))
        rows.append((i, text if good else " ".join(w + "***" for w in text.split())))
        labels.append((i, int(good), 0))
    labels += [(5, 1, 0), (6, None, None), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks, width=64)
    got = {r.doc_id: r.score for r in quality.grade(docs, model).collect()}
    held = [i for i in range(900) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == (i % 4 != 0) for i in held) / len(held) > 0.97
    scores = [r.score for r in quality.grade(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert quality.grade(nothing, model).count() == 0
    unknown = quality.fit(nothing, marks)
    assert {r.score for r in quality.grade(odd, unknown).collect()} == {0.5}


def test_isotonic_pools_violators():
    knots, levels = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0.0, 1.0, 0.0, 1.0, 0.0]))
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    assert levels == pytest.approx([0.0, 0.5])


def test_folds_are_crc32_of_the_id(spark):
    import zlib

    from flowlens.llm.common import fold_of

    for r in spark.range(50).select("id", fold_of("id", 4).alias("f"), fold_of(F.lit(None).cast("long"), 4).alias("n")).collect():
        assert r.f == zlib.crc32(str(r.id).encode()) % 4 and r.n == 0


def test_letters_that_grow_in_lower_case_count_whole():
    text = "\u0130" * 200 + " abcdefgh" * 40  # each of the first gives two code points
    found = sum(len(langid.subwords(p, a, b, 1 << 14)) for p, a, b in langid.pieces(text))
    assert found == sum(len(langid.subwords(p, a, b, 1 << 14)) for p, a, b in langid.pieces(text.lower())) > 200 + 40 * 8
