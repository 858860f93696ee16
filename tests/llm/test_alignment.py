"""Groups, links and counts of two tokenizers against all pairs of byte ranges."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings, strategies as st

from flowlens.llm import alignment
from tests_llm_data import prose

FILES = alignment.Vocabularies().files()


@pytest.fixture(scope="module")
def coders():
    return alignment.ByteLevel(FILES[0]), alignment.Pieces(FILES[1])


rising = st.lists(st.integers(1, 40), min_size=1, unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(rising, rising)
def test_groups_end_where_both_end(x, y):
    last = max(x[-1], y[-1]) + 1
    x, y = [*x, last], [*y, last]
    ends, got = sorted(set(x) & set(y)), []
    for i, i_end, j, j_end, met in alignment.align(x, y):
        assert x[i_end - 1] == y[j_end - 1]
        if not met:
            assert i_end - i == j_end - j and x[i:i_end] == y[j:j_end]
            got += x[i:i_end]
        else:
            got.append(x[i_end - 1])
            over = [(p, q) for p in range(i, i_end) for q in range(j, j_end) if max([0, *x[:p][-1:], *y[:q][-1:]]) < min(x[p], y[q])]
            assert met == over
    assert got == ends


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_both_byte_pair_coders_agree(text):
    coder = alignment.ByteLevel(FILES[0]) if not hasattr(test_both_byte_pair_coders_agree, "c") else test_both_byte_pair_coders_agree.c
    test_both_byte_pair_coders_agree.c = coder
    assert coder(text) == coder.slow.encode(" " + text, add_special_tokens=False).ids


def plain(texts: list[str | None]) -> list[tuple]:
    slow = tokenizers.Tokenizer.from_file(alignment.BYTE_LEVEL)
    slow.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    alphabet = alignment.byte_alphabet()

    def piece(i: int) -> bytes:
        return bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()

    def ranges(parts: list[bytes]) -> list[tuple[int, int]]:
        out = [(0, 0)]
        for p in parts:
            out.append((out[-1][1], out[-1][1] + len(p)))
        return out[1:]

    rows, counts = [], collections.Counter()
    for text in texts:
        got = slow.encode(" " + (text or ""), add_special_tokens=False)
        a, b = got.ids, pieces.encode(text or "")
        pa, pb = [bytes(alphabet[c] for c in t) for t in got.tokens], [piece(i) for i in b]
        if not text or b"".join(pa) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
            rows.append(None)
            continue
        ra, rb = ranges(pa), ranges(pb)
        links = [(a[i], b[j]) for i, x in enumerate(ra) for j, y in enumerate(rb) if max(x[0], y[0]) < min(x[1], y[1])]
        counts.update(links)
        groups, at = [], 0
        for end in sorted({x[1] for x in ra} & {y[1] for y in rb}):
            groups.append("|".join(",".join(str(t) for t, r in zip(ids, rs, strict=True) if at <= r[0] < end) for ids, rs in ((a, ra), (b, rb))))
            at = end
        rows.append((len(a), len(b), groups, links))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, "", ""))
            continue
        n_a, n_b, groups, links = row
        said = ";".join(groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest(), said))
    return out


ODD = ["<|endoftext|> and </s> <0x41>", "tabs\tand\n\nlines  two spaces ", " leading", "▁under", "日本語のテキスト", "naïve café Ελλάδα \U0001f600\U0001f680", "a" * 3000, "\x00\x01 nul", "1234567890 12,345.67", "é   wide　space", "don't we'll I'M", "ꙮ ༀ 𐍈"]


def test_documents_equal_all_pairs(spark, odd):
    rng = random.Random(1)
    texts = ODD + [prose(i, rng.randrange(1, 60)) for i in range(20)] + [prose(1, 30)] * 3 + [None, ""]
    want = [(i, *x) for i, x in enumerate(plain(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    for most in (1 << 20, 0):
        got = alignment.align_tokenizers(docs, say_groups=True, max_shared=most)
        assert sorted(tuple(r) for r in got.select(*columns).collect()) == want
    assert sum(x[1] == 0 for x in want) >= 3 and sum(x[4] > x[3] for x in want) > 20


def test_odd_tables(spark, odd, nothing):
    rows = odd.select("doc_id", "text").collect()
    for most in (1 << 20, 0):
        got = alignment.align_tokenizers(odd, max_shared=most).collect()
        assert len(got) == len(rows) and sum(r.n_a == 0 for r in got) >= 2
        assert alignment.align_tokenizers(nothing, max_shared=most).count() == 0
    texts = odd.withColumn("doc_id", odd["text"])  # ids that are texts pass through
    assert dict(alignment.align_tokenizers(texts).dtypes)["doc_id"] == "string"
