"""Lexical search, decontamination and tokenizer alignment against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from landfold.llm import alignment, decontamination, lexical_search
from landfold.llm.common import coded, decoded, words_of

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {k: k + 32 for k in range(65, 91)}
ODD = [None, "", "...", "Ünï côdé ÄÖ", "a_b a-b A B x\x00y", "TOKEN<|endoftext|></s>", "▁ ▁x", "日本語 テキスト", "a" * 3000, "\n\t  spaces   \n", "é ﬁ İ"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus(seed, n, size=60, most=60):
    rnd = random.Random(seed)
    vocabulary = [f"W{k}" if k % 3 else f"ö{k}" for k in range(size)]
    weights = [1 / (k + 1) for k in range(size)]
    made = [" ".join(rnd.choices(vocabulary, weights, k=rnd.randint(1, most))) for _ in range(n)]
    return made + made[:5] + ODD


def docs_of(spark, texts):
    rows = [(None if k == 3 else k // 2 if k < 8 else k, t, "x", float(k)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, rank double")


def test_words_and_codes():
    for text in [*ODD, corpus(1, 1)[0]]:
        assert [w.decode() for w in words_of((text or "").encode())] == words(text)
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**50, 5])
    assert (decoded(coded(values)[0]) == values).all() and not len(decoded(coded(values[:0])[0]))


def ranked(docs, items, k):
    each = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in each), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in each:
            n = sum(c.values())
            s = 0
            for t in words(text):
                if c[t]:
                    m = 25 + (75 * n * n_docs) // n_terms
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(scores, key=lambda v: (v[0], v[1], v[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment_bytes, shard_docs, together", [(1 << 20, 1 << 20, 256), (2_000, 40, 3)])
def test_search_equals_scoring_all(spark, segment_bytes, shard_docs, together):
    texts = corpus(2, 400)
    docs = docs_of(spark, texts)
    rnd = random.Random(3)
    items = [(k, " ".join(rnd.choices(texts[k].split(), k=20))) for k in range(12)] + [(0, "w1 w1 W2 w5"), (1, texts[1]), (1, texts[1]), (20, None), (21, "..."), (22, "unheard"), (None, "w4 ö3 日本語"), (23, "w1")]
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)), 10, segment_bytes, shard_docs, together).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=repr) == ranked([(r.doc_id, r.text) for r in docs.collect()], items, 10)


def test_search_of_nothing(spark):
    docs, items = docs_of(spark, corpus(2, 5)), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == lexical_search.search(docs, items.limit(0)).count() == lexical_search.search(docs.where("text is null"), items).count() == 0


def test_blocks_are_rejected_before_they_are_decoded(spark):
    """A rare term decides; of the long list of a common one only the blocks of its documents are decoded."""
    texts = [f"common {'filler ' * (k % 7)}" + (" rare rare rare" if k % 400 == 7 else "") for k in range(8000)]
    docs = docs_of(spark, texts)
    n_docs, n_terms = lexical_search.corpus_counts(docs)
    index = lexical_search.build_index(docs.coalesce(1), n_docs, n_terms)
    uses = spark.createDataFrame([(b"common", 1), (b"rare", 5000)], "term binary, w long").withColumn("uses", F.expr("array(struct(0L AS item, 0L AS item_id, 1L AS q))"))
    shard = lexical_search.Shard(index.join(uses, "term", "left").where("term is null or w is not null").toArrow(), n_docs, n_terms)
    read = []
    decode = shard.decode
    shard.decode = lambda blocks: (read.append(len(blocks)), decode(blocks))[1]
    shard.search([(k, w) for k, w in enumerate(shard.weight)], 10)
    assert len(read) == 2 and read[1] <= 20 < sum(b - a for a, b in shard.blocks) // 4


def leaks(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        for a in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add("" if name is None else str(name))
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                its = windows.get(tuple(w[a : a + size]))
                if its:
                    hit |= set(range(a, a + size))
                    names |= its
        out.append((i, len(w), sorted(hit), sorted(names)))
    return sorted(out, key=repr)


def longest(text, item):
    a, b = words(text), words(item)
    best = (0, 0)
    for p in range(len(a)):
        for q in range(len(b)):
            n = 0
            while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                n += 1
            if n > best[0]:
                best = (n, p)
    return best


@pytest.mark.parametrize("shard_bytes, batch_bytes", [(1 << 20, 1 << 20), (700, 300)])
def test_leaks_equal_comparing_all(spark, shard_bytes, batch_bytes):
    rnd = random.Random(5)
    texts = corpus(6, 60, size=9, most=80)
    passages = [" ".join(rnd.choices(texts[k].split(), k=25)) for k in range(8)]
    texts = [f"{t} {passages[k % 8].upper()} {t}" if k % 3 == 0 and t else f"{t} {' '.join(passages[k % 8].split()[2:14])}" if k % 3 == 1 and t else t for k, t in enumerate(texts)]
    items = [*enumerate(passages), (3, "W1 w2 w4"), (8, None), (9, "!!"), (None, texts[1]), (10, passages[2]), (2, passages[5]), (11, "nowhere at all"), (12, "w1 W1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = docs_of(spark, texts).withColumn("hits", F.lit(1))
    found = decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), shard_bytes, batch_bytes)
    assert found.columns == ["doc_id", "text", "score", "rank", "n_words", "hits", "matches"]
    rows = found.collect()
    got = sorted(((r.doc_id, r.n_words, [p for s in r.hits for p in range(s.start, s.end)], [m.item_id for m in r.matches]) for r in rows), key=repr)
    assert got == leaks([(r.doc_id, r.text) for r in docs.collect()], items)
    assert sum(bool(h) for *_, h, _ in got) > 20
    one = {str(k): p for k, p in enumerate(passages) if k not in (2, 3)}
    for r in rows[:40]:
        assert all((m.length, m.start) == longest(r.text, one[m.item_id]) for m in r.matches if m.item_id in one)
    assert decontamination.decontaminated(docs.drop("hits"), spark.createDataFrame(items, "item_id long, text string")).count() == sum(not h for *_, h, _ in got)


def test_leaks_of_nothing(spark):
    docs, items = docs_of(spark, corpus(2, 5)), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert decontamination.find_leaks(docs.limit(0), items).count() == 0
    clean = decontamination.find_leaks(docs, items.limit(0)).collect()
    assert len(clean) == docs.count() and not any(r.hits or r.matches for r in clean)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_is_sorted(seed):
    """By the first ten words, up to the first unknown one."""
    rnd = np.random.default_rng(seed)
    known = (2, 5, 300, 2**20, 2**40, 3)[seed]
    line = rnd.integers(0, min(known, 4) + 1, 400) * max(1, known // 4)
    line[100:200] = line[:100]
    at = decontamination.suffix_array(line, known)
    padded = np.append(line, np.zeros(10, int))
    heads = [tuple(w if padded[k : k + n + 1].all() else 0 for n, w in enumerate(padded[k : k + 10])) for k in at]  # what stands after a 0 matches nothing
    assert sorted(at) == np.flatnonzero(line).tolist() and heads == sorted(heads)


def spelled(texts):
    """Ids and bytes by the library of the .json file and by the pieces' text."""
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(p.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    plain = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 172 or 174 <= k <= 255]
    byte_of = {chr(k): k for k in plain} | {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in plain)}
    out = []
    for t in texts:
        if not t:
            out.append(([], []))
            continue
        x = [(k, bytes(byte_of[c] for c in a.id_to_token(k))) for k in a.encode(" " + t, add_special_tokens=False).ids]
        y = [(k, bytes([int(s[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", s) else s.replace("▁", " ").encode()) for k in b.encode(t) for s in [b.id_to_piece(k)]]
        good = all(b"".join(w for _, w in ids) == (" " + t).encode() for ids in (x, y))
        out.append((x, y) if good else ([], []))
    return out


def ends(ids):
    at, out = 0, []
    for k, w in ids:
        out.append((k, at, at + len(w)))
        at += len(w)
    return out


def by_hand(texts):
    docs = []
    for x, y in spelled(texts):
        x, y = ends(x), ends(y)
        links = [(i, j) for i, a, b in x for j, c, d in y if a < d and c < b]
        cuts = sorted({b for *_, b in x} & {b for *_, b in y})
        groups = [([i for i, a, b in x if low <= a and b <= high], [j for j, c, d in y if low <= c and d <= high]) for low, high in zip([0, *cuts], cuts)]
        docs.append((len(x), len(y), links, groups))
    held = Counter(pair for *_, links, _ in docs for pair in set(links))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    text = lambda groups: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return [(n, m, len(g), len(ls), sum(held[p] == most[p[0]] for p in ls), sum(held[p] for p in ls), text(g)) for n, m, ls, g in docs]


@pytest.mark.parametrize("run_bytes, chunk_bytes", [(1 << 20, 8 << 20), (300, 900), (1, 1)])
def test_alignment_equals_all_pairs_of_spans(spark, run_bytes, chunk_bytes):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers as p

    rnd = random.Random(8)
    parts = ["the", "onesen", "erblest", "Größe", "naïve", "12345", "http://a.b/c?d=e", "  ", "\n\n", "日本", "\U0001f600", "don't", "<s>", "<|endoftext|>", "é", "﻿", "ﬁ", "\x00", " "]
    texts = [*ODD, *(" ".join(rnd.choices(parts, k=rnd.randint(1, 40))) for _ in range(40)), *("".join(rnd.choices(parts, k=rnd.randint(1, 12))) for _ in range(40)), "the the the", "the the the"]
    docs = docs_of(spark, texts)
    done = alignment.align(docs.withColumn("groups", F.lit(1)), p.path("byte_bpe_50k.tiktoken"), p.PATTERN, p.path("piece_bpe_32k.model"), 32_000, None, run_bytes, chunk_bytes).collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = [(r.doc_id, *w) for r, w in zip(docs.collect(), by_hand([r.text for r in docs.collect()]))]
    assert sorted(((r.doc_id, *(r[c] for c in names)) for r in done), key=repr) == sorted(want, key=repr)
    assert alignment.sha256_or_empty("") == "" and len(alignment.sha256_or_empty("1|2")) == 64


def test_no_documents_align_to_none(spark):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers as p

    paths = (p.path("byte_bpe_50k.tiktoken"), p.PATTERN, p.path("piece_bpe_32k.model"), 32_000)
    docs = docs_of(spark, [None, "", "x"])
    assert alignment.align(docs.limit(0), *paths).count() == 0
    assert [tuple(r)[1:] for r in alignment.align(docs.where("coalesce(text, '') = ''"), *paths).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


@pytest.mark.parametrize("seed", range(8))
def test_diagonal_runs(seed):
    """Long one-to-one stretches, shifts both ways, and irregular groups at the start and end."""
    rnd = np.random.default_rng(seed)
    whole = np.arange(1, 4000)
    a, b = (np.append(whole[:-1][rnd.random(len(whole) - 1) < (0.999, 0.9, 0.5, 0.05)[(seed + k) % 4]], 3999) for k in (0, seed % 3))
    groups, link_a, link_b = alignment.irregular_groups(a, b)
    common = np.intersect1d(a, b)
    ia, ib = np.searchsorted(a, common), np.searchsorted(b, common)
    every = np.stack([np.append(0, ia[:-1] + 1), ia + 1, np.append(0, ib[:-1] + 1), ib + 1], axis=1)
    odd = every[(every[:, 1] - every[:, 0] > 1) | (every[:, 3] - every[:, 2] > 1)]
    assert (groups == odd).all() and len(link_a) == len(link_b) == (odd[:, 1] - odd[:, 0] + odd[:, 3] - odd[:, 2] - 1).sum()
