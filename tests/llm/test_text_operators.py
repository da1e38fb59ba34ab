"""The text operators against brute-force versions, and on nulls, empties, repeats, clashing columns and empty tables."""

import collections
import hashlib
import io
import itertools
import json
import math
import random
import re
import time
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, html_text, ngram_join, packing, personal_data, quality_classifier, quality_rules, substring_dedup, tool_calls, warc
from tessera.llm.common import Scratch
from tessera.llm.components import components
from tessera.llm.queries import QUERIES, SQL
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def texts(spark, rows, extra=True):
    """documents (doc_id, text), with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:
        for c in ("sig", "component", "part", "ids", "rank", "anchors", "spans", "n_words", "__row", "quality_ledger"):
            df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


def corpus(seed=3, n=60):
    """Random texts with exact copies, near copies, shared passages, nulls, empties and one very long word."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    rows, passage = [], prose(40)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 and rows:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = prose(rng.randint(1, 160))
        if kind > 0.85:
            text += "\n" + passage
        rows.append((len(rows), text))
    return [*rows, (n, ""), (n + 1, None), (n + 2, "  \t\n"), (n + 3, "one two"), (n + 4, "ONE two"), (n + 5, "x" * 5000), (None, rows[0][1])]


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def linked(rows):
    sets = shingle_sets([r for r in rows if r[0] is not None])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("seed", [3, 4])
def test_ngram_join_is_brute_force(spark, scratch, seed):
    rows = corpus(seed)
    got = ngram_join.link(texts(spark, rows), scratch).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == linked(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None] and len(got) == len(rows)


def test_ngram_join_near_misses_around_a_centre(spark, scratch):
    """A family of edits on both sides of the threshold, so that all rounds and the left-over search have work."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(220)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.choice([2, 4, 5, 6, 7, 9])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(60)}"
        rows.append((i, " ".join(words)))
    got = ngram_join.link(texts(spark, rows), scratch).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows)


def test_ngram_join_repeated_rows_and_empty_table(spark, scratch):
    assert ngram_join.link(texts(spark, []), scratch).count() == 0
    got = ngram_join.link(texts(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")]), scratch).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1)]


def test_similar_sets_share_enough_signatures():
    """What the pruning rests on: a pair at the threshold shares at least the number that either's code names, in one band."""
    rng = np.random.default_rng(5)
    for size in (5, 9, 14, 40, 90, 140, 500):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**64, size, np.uint64))
            drop = int(rng.integers(0, len(a) // 9 + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**64, drop, np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)) or not drop:
                continue
            (sa, ca), (sb, cb) = ngram_join.signatures(a), ngram_join.signatures(b)
            bands = collections.defaultdict(int)
            for s in np.intersect1d(sa, sb):
                bands[(-1 - ca[sa == s][0]) % ngram_join.BAND] += 1
            need = lambda codes, band: {int((-1 - c) // ngram_join.BAND) for c in codes if (-1 - c) % ngram_join.BAND == band}
            assert any(n >= max(need(ca, k) | need(cb, k)) for k, n in bands.items())


def enough(a, b):
    """Whether in one band the sets share as many signatures as either's code names there."""
    (sa, ca), (sb, cb) = ngram_join.signatures(np.sort(a)), ngram_join.signatures(np.sort(b))
    in_a, in_b = dict(zip(sa.tolist(), (-1 - ca).tolist(), strict=True)), dict(zip(sb.tolist(), (-1 - cb).tolist(), strict=True))
    bands = collections.defaultdict(list)
    for s in in_a.keys() & in_b.keys():
        bands[in_a[s] % ngram_join.BAND].append(max(in_a[s], in_b[s]) // ngram_join.BAND)
    return any(len(n) >= max(n) for n in bands.values())


def test_sets_of_four_and_five_in_all_parts_share_enough_signatures():
    """Four common members and one more, in every way they can lie in the nine parts of their band."""
    members = [[np.uint64((part * 2 + 1) * (2**64 // 18) + i) for i in range(5)] for part in range(9)]
    for four in itertools.combinations_with_replacement(range(9), 4):
        a = np.array([members[part][i] for i, part in enumerate(four)], np.uint64)
        for part in range(9):
            assert enough(a, np.append(a, members[part][4])), (four, part)


def test_sets_of_ten_to_forty_share_enough_signatures():
    """Random pairs at the threshold, members crowded into a few parts so that some sets keep signatures without members."""
    rng = np.random.default_rng(6)
    for _ in range(20_000):
        n = int(rng.integers(10, 41))
        more = int(rng.integers(0, n // 4 + 1))
        less = (n - 4 * more) // 5 if n > 4 * more else 0
        span = 64 - int(rng.integers(0, 5))
        pool = np.unique(rng.integers(0, 2**span, n + more + 4, np.uint64, endpoint=False))[: n + more]
        pool = pool[rng.permutation(len(pool))]
        a, b = pool[: n], pool[less:]
        if len(pool) == n + more and 100 * (n - less) >= 80 * len(pool) and more + less:
            assert enough(a, b), (n, more, less, span)


def thue_morse():
    """Two texts of one word each that differ in every byte and have equal polynomial hashes modulo 2**64, whatever the base."""
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_regular_texts_are_told_apart(spark, scratch):
    a, b = thue_morse()
    measured = quality_rules.measure(pa.array([f"{a}\n{b}", f"{a}\n{a}", f"{a} {a} {a} {b} {b} {b}", " ".join([a, b, a] * 2)])).to_pylist()
    assert [(m["n_dup_lines"], m["n_repeat_words"]) for m in measured] == [(0, 0), (1, 0), (0, 0), (0, 6)]
    got = ngram_join.link(texts(spark, [(1, a), (2, b), (3, a)]), scratch).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}
    distinct = quality_classifier.FEATURES.index("distinct_words")
    assert quality_classifier.features(pa.array([f"{a} {b}", f"{a} {a}"]))[:, distinct].tolist() == [1.0, 0.5]
    rows = [(1, a), (2, b), (3, a[:300]), (4, b[500:700])]
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(texts(spark, rows), scratch).collect()} == removed(rows)


def test_ngram_join_folds_copies_before_signing(spark, scratch):
    """Copies of a text that a task has met sign nothing, under ids before and after, and when it forgets."""
    rows = [(i, f"one text that {'is' if i % 3 else 'was'} copied many times over and over again") for i in range(90, 0, -1)] + [(None, "one text"), (100, "one")]
    signed = ngram_join._signed(texts(spark, rows).coalesce(1)).collect()
    assert len({r.doc_id for r in signed if r.n < 0}) == 2 and sum(r.of is not None for r in signed) == 88
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(texts(spark, rows), scratch).collect() if r.doc_id is not None}
    assert got == linked(rows)


def test_line_and_gram_codes_are_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", "é", " ", "\n", "\r", "\t", "ab"]) for _ in range(rng.randint(0, 40)))
        m = quality_rules.measure(pa.array(["x\n", t, ""])).to_pylist()[1]
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
        assert (m["n_dup_lines"], m["n_repeat_words"], m["n_words"], m["n_lines"]) == (len(lines) - len(set(lines)), len(repeated), len(words), t.count("\n") + 1)


def test_components(spark, scratch):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(60, 50), (50, 60), (60, 55)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(e, scratch).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 55: 50}


def test_packing(spark, scratch):
    from tokenizers import Tokenizer

    rows = corpus(5) + [(0, "repeated id"), (900, "It's a DON'T 'start x's9 3.14 Été×÷ÀB,c <|endoftext|> 日本 İ, Σ. " * 300)]
    t = Tokenizer.from_file(packing.vocabulary_path())
    want = collections.Counter()
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = packing.pack(texts(spark, rows), scratch, window=64).collect()
    sequences, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.sequence_id * 64 + r.offset - r.start, r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    for k, pieces in sequences.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or k == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    assert collections.Counter((i, n, zlib.crc32(b"".join(x for _, x in sorted(p)))) for (_, i, n), p in docs.items()) == want
    assert packing.pack(texts(spark, []), scratch).count() == 0


def test_chunks_encode_as_whole_texts():
    rng = random.Random(2)
    letters = "aBcé É'ß9,.#$×÷İΣσ \n\t 日²½ſŉǰ_-" + "́\u0085 \U0001f600"
    t = packing._tokenizer(packing.vocabulary_path())
    rows = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    ids, off = packing.encode(pa.array(rows), packing.vocabulary_path())
    for i, x in enumerate(rows):
        assert ids[off[i] : off[i + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 2]


def removed(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        gone, spans, end = bytearray(len(b)), 0, -1
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                spans += p > end
                end = p + length
                gone[p:end] = b"\1" * length
            else:
                seen.add(b[p : p + length])
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_is_brute_force(spark, scratch, seed):
    rows = corpus(seed, 80) + [(200, "ab" * 400), (201, "ab" * 300 + "c"), (202, "q" * 99), (203, "q" * 100)]
    got = substring_dedup.remove_repeats(texts(spark, rows), scratch).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(rows)
    assert len(got) == len(rows)


def test_substring_dedup_of_a_passage_in_all_documents(spark, scratch):
    """A passage in differing surroundings, in every document, twice in some, and documents that are equal but for a little."""
    rng = random.Random(4)
    words = lambda k: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(k))
    passage, base = words(60), words(120)
    rows = [(i, f"{words(rng.randint(0, 30))} {passage} {words(rng.randint(0, 30))}" + f" {passage}" * (i % 7 == 0)) for i in range(150, 0, -1)]
    rows += [(200 + i, base[:k] + "#" + base[k:]) for i, k in enumerate(range(0, len(base), 5))]
    got = substring_dedup.remove_repeats(texts(spark, rows).repartition(5), scratch).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(rows)
    spread = substring_dedup._ranked(texts(spark, rows).select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("order"), F.lit(0).alias("tie"), "text").coalesce(1))
    assert spread.groupBy("rank").count().agg(F.max("count")).first()[0] < 20


def test_substring_dedup_in_parts(spark, scratch, monkeypatch):
    """Long documents are ranked in overlapping parts."""
    rng = random.Random(9)
    long = "".join(rng.choice("abc ") for _ in range(9000))
    monkeypatch.setattr(substring_dedup, "PART", 1000)
    data = np.frombuffer(long.encode(), np.uint8)
    whole = substring_dedup.anchors(data, np.array([0, len(data)]))
    windows = {(p, d) for p, lo, hi in zip(whole[1], whole[2], whole[3], strict=True) for d in range(lo, hi + 1)}
    parts = set()
    for _, start, part, off in substring_dedup._parts(pa.array([long])):
        a = substring_dedup.anchors(part, off)
        parts |= {(p + start, d) for p, lo, hi in zip(a[1], a[2], a[3], strict=True) for d in range(lo, hi + 1)}
    assert parts == windows


def test_substring_dedup_repeated_ids_and_empty_table(spark, scratch):
    assert substring_dedup.remove_repeats(texts(spark, []), scratch).count() == 0
    a, b = "x y z " * 30, "k l m " * 30
    got = substring_dedup.remove_repeats(texts(spark, [(1, a), (1, a), (1, b), (2, a + b)]), scratch).collect()
    assert len(got) == 4 and {r.n_removed for r in got if r.doc_id == 2} != {0}


def test_decontamination(spark, scratch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(i, prose(rng.randint(20, 40))) for i in range(8)] + [(8, None), (9, "")]
    rows = []
    for i in range(40):
        text = prose(60)
        if i % 2:
            passage = list(items[i % 8][1])
            for _ in range(rng.randint(0, 12)):
                passage[rng.randrange(len(passage))] = rng.choice("abc ")
            text = text[:100] + " " + "".join(passage).upper() + " " + text[100:]
        rows.append((i, text))
    rows += [(40, None), (41, ""), (None, items[0][1]), (0, items[1][1])]

    def distance(p, t):
        last = [0] * (len(t) + 1)
        for i in range(1, len(p) + 1):
            now = [i]
            for j in range(1, len(t) + 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (p[i - 1] != t[j - 1])))
            last = now
        return min(last)

    want = []
    for i, t in rows:
        for k, x in items:
            x, n = decontamination.normal(x or ""), decontamination.normal(t or "")
            if x and n and (d := distance(x, n)) <= len(x) * 5 // 100:
                want.append((i, k, d, len(x) * 5 // 100))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(7))
    got = decontamination.contaminated(texts(spark, rows), bench).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and len(want) > 10
    kept = decontamination.decontaminate(texts(spark, rows), bench, scratch)
    bad = {w[0] for w in want} - {None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None and i not in bad)
    assert decontamination.contaminated(texts(spark, []), bench).count() == 0
    assert decontamination.contaminated(texts(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 50)
    sentence = lambda i: f"item {i * 1111} is a sentence of {'abcde'[i] * 9}"
    bench = spark.createDataFrame([(i, sentence(i)) for i in range(5)], "item_id bigint, text string")
    docs = texts(spark, [(i, f"before {sentence(i)} after") for i in range(5)])
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()) == [(i, i) for i in range(5)]


KINDS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def base(t):
    def ok(k, v):
        g = re.sub("[^0-9]", "", v)
        if k == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if k == "card":
            return 16 <= len(g) <= 19 and sum(y if i % 2 == 0 else (y * 2 - 9 if y > 4 else y * 2) for i, y in enumerate(map(int, reversed(g)))) % 10 == 0
        return k != "phone" or 8 <= len(g) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS for m in p.finditer(t) if ok(k, m[0])]


def test_personal_data_base_is_brute_force(spark, scratch):
    rng = random.Random(6)
    bits = ["a@b.cc", "x@y.z.w_q@e.f", "@", ".", "%", "1.2.3.4", "1.2.3.4.5.6.7.8", "255.256.1.1", "000255.1.1.1", "4532015112830366", "4532 0151-1283 0366", "+1 (487) 555-7209", "+12", " ", "-", "é", "\U0001f600", "9", "77", "word", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(400)] + [(400, None), (401, ""), (402, "7" * 20000), (403, "a." * 9000 + "@" + "b." * 9000), (None, "q@w.ee")]
    got = personal_data.find(texts(spark, rows), scratch).select("doc_id", "text", "pii_base").collect()
    for r in got:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.pii_base] == base(r.text or ""), r.text
        assert all((r.text or "")[s.start : s.end] == s.value for s in r.pii_base)
    assert len(got) == len(rows)


def test_personal_data_learns_contexts(spark, scratch):
    seeds = [(i, f"please call my number +1 (48{i}) 555-720{i} today") for i in range(8)]
    rows = seeds + [(20, "please call my number 12-3456-789012 today"), (21, "chapter 123456789 of the book"), (22, "nothing here")]
    got = {r.doc_id: [s.value for s in r.pii_id] for r in personal_data.find(texts(spark, rows), scratch).collect()}
    assert got[20] == ["12-3456-789012"] and got[21] == [] and got[22] == []
    red = {r.doc_id: r.text for r in personal_data.redact(texts(spark, rows), scratch).collect()}
    assert red[20] == "please call my number <ID> today" and red[0] == "please call my number <PHONE> today" and red[22] == "nothing here"
    assert personal_data.find(texts(spark, []), scratch).count() == 0


def test_personal_data_recall_of_planted_identifiers(spark, scratch):
    """Identifiers of forms that no seed has, planted behind contexts that seeds share; and numbers that are none, behind other words."""
    rng = random.Random(12)
    contexts = ["reach me under", "my number is", "account holder", "member card", "token =", "patient file", "écrivez à"]
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    prose = lambda k: " ".join("".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 9))) for _ in range(k))
    seeds = [lambda: f"u{digits(4)}@mail.example.com", lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: f"10.{rng.randrange(256)}.{rng.randrange(256)}.7", lambda: f'"{hashlib.sha1(digits(9).encode()).hexdigest()}"']
    unseen = [lambda: f"ID-{digits(7)}", lambda: f"{digits(3)}/{digits(5)}-x{digits(2)}", lambda: f"K{digits(9)}Z"]
    rows, planted, innocent = [], {}, set()
    for i in range(1500):
        kind, c = rng.random(), rng.choice(contexts)
        if kind < 0.4:
            body = f"{c} {rng.choice(seeds)()}"
        elif kind < 0.6:
            planted[i] = rng.choice(unseen)()
            body = f"{c} {planted[i]}"
        else:
            innocent.add(i)
            body = f"{rng.choice(['chapter', 'weighs about', 'edition of', 'sum'])} {digits(rng.randint(6, 9))}"
        rows.append((i, f"{prose(12)} {body} {prose(8)}"))
    # A checksum among words that no seed shares is none; long words in front are read whole, not by their ends; repeated rows repeat.
    lone = hashlib.sha1(b"x").hexdigest()
    rows += [(2000, f"the build of {lone} went well"), (2001, f"y{'w' * 3000} AB{digits(8)} end"), (2002, f"{'w' * 3000} token = AB12345678 end"), (2002, f"{'w' * 3000} token = AB12345678 end")]
    rows += [(3000 + i, f"so x{'w' * 3000} u{digits(4)}@mail.example.com") for i in range(6)] + [(3100, f"so x{'w' * 3000} AB777888999 end")]
    got = collections.defaultdict(list)
    for r in personal_data.find(texts(spark, rows), scratch).collect():
        got[r.doc_id] += [s.value for s in r.pii_id]
    caught = sum(v in got[i] for i, v in planted.items())
    assert caught >= 0.9 * len(planted) and not any(got[i] for i in innocent) and not got[2000]
    assert got[2001] == [] and got[2002] == ["AB12345678"] * 2 and got[3100] == ["AB777888999"]
    assert sum(len(v) == 40 for vs in got.values() for v in vs) > 100


def test_quality_ledger(spark):
    rows = [(1, None), (2, ""), (3, "a b c " * 40), (4, " ".join(f"word{i}" for i in range(80))), (5, "x\nx\nx\n\n \nx"), (None, "#$ " * 60), (4, "dup"), (6, "éé " * 3)]
    d = quality_rules.ledger(texts(spark, rows))
    got = {r.doc_id: r.quality_ledger for r in d.where("text <> 'dup' or text is null").collect()}
    assert (got[1].n_words, got[2].n_words, got[3].n_words, got[3].n_repeat_words) == (0, 0, 120, 120)
    assert got[4].failed_bits == 0 and got[5].n_dup_lines == 3 and got[6].word_chars == 6 and got[None].n_symbols == 120
    assert d.count() == len(rows) and quality_rules.ledger(texts(spark, [])).count() == 0
    kept = quality_rules.apply_policy(texts(spark, rows))
    assert [r.doc_id for r in kept.collect()] == [4] and kept.columns == texts(spark, rows).columns
    a = {r.rule: (r.n_failed, r.n_only_this) for r in quality_rules.ablation(d).collect()}
    assert a["few_words"][0] == 5 and set(a) == set(quality_rules.POLICIES["v1"])


def page(body):
    return f"<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a &amp; b&nbsp;c<p>d<br>e", "a & b c\nd\ne"),
        (page("<header>Site</header><nav><a href=x>Home</a></nav><article><h1>T</h1><p>Some long text that is read.</p><p>More <b>bold</b> text.</p></article><footer>f</footer>"), "T\nSome long text that is read.\nMore bold text."),
        (page("<div class='main'><p>First paragraph of a text without an article element.</p><p>Second paragraph, as long as the first.</p></div><div id=cookie-notice><p>We use cookies on this site, as every site does.</p></div><aside>side</aside><div class='comments'><p>I liked this.</p></div><form>q<input></form>"), "First paragraph of a text without an article element.\nSecond paragraph, as long as the first."),
        (page("<article><section><p>aaa bbb ccc ddd</p><p>eee fff ggg hhh</p></section><section><p>iii jjj kkk lll</p></section></article>"), "aaa bbb ccc ddd\neee fff ggg hhh\niii jjj kkk lll"),
        ("<article><p>cut off in the mid<di", "cut off in the mid"), ("<!-- <p>x</p> --><p>y</p><style>p{}", "y"), ("a < b and <3", "a < b and <3"),
    ],
)
def test_html(html, text):
    assert html_text.extract(html) == text


@pytest.mark.parametrize(
    "wrapper",
    [
        "class='content has-sidebar'", "class=no-sidebar", "class='page with-ads'", "class=elementor-widget-container", "class=search-results", "class=share-price",
        "class='block hidden md:flex'", "title='a hidden gem'", "class=byline", "class=related", "class=social", "class=widget", "data-id=ad", "class=sidebar",
    ],
)
def test_html_names_do_not_empty_the_article(wrapper):
    paragraphs = "<p>The first paragraph of a text that is read.</p><p>The second paragraph, as long as the first one.</p>"
    want = "The first paragraph of a text that is read.\nThe second paragraph, as long as the first one."
    assert html_text.extract(page(f"<div {wrapper}>{paragraphs}</div><div class=ad><p>Buy.</p></div>")) == want
    assert html_text.extract(page(f"<div {wrapper}><article>{paragraphs}</article></div><div class=comments><p>{'I liked this. ' * 40}</p></div>")) == want


@pytest.mark.parametrize("names", ["class=ad", "class='x site-footer'", "id=mainNav", "role=navigation", "class=cookie-notice", "class=comment-list", "hidden", "hidden=''", "style='display: none'", "aria-hidden=true"])
def test_html_names_that_mark_boilerplate(names):
    assert html_text.extract(page(f"<div><p>The first paragraph of a text that is read.</p><p>The second paragraph.</p></div><div {names}><p>Not of the text.</p></div>")) == "The first paragraph of a text that is read.\nThe second paragraph."


def test_html_forms_and_labels():
    two = "<p>The first paragraph of a text that is read.</p><p>The <label>second</label> paragraph, as long as the first one.</p>"
    want = "The first paragraph of a text that is read.\nThe second paragraph, as long as the first one."
    assert html_text.extract(page(f"<div>{two}</div><form><label>Name</label><input><button>Send</button></form>")) == want
    assert html_text.extract(f"<body><form action=x><input type=hidden><div><h1>Head</h1>{two}</div><button>Send</button><select><option>a</select></form></body>") == f"Head\n{want}"
    assert html_text.extract(page("<form><p>Name</p><textarea>x</textarea></form>")) == ""


def test_html_of_every_page_is_its_article(spark):
    """The pages' articles cut out by hand: what is between the tags, a line for each run between breaks."""
    for r in html_text.main_text(spark.read.parquet(f"{SMALL}/pages.parquet").union(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).select("page_id", "url", "html", F.col("html").alias("source"))).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), ["page_id", "url"]).collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        lines = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|br|h1|h2|div)[^>]*>", re.sub(r"<!--.*?-->", "", inner, flags=re.S))]
        assert r.text == "\n".join(x for x in lines if x)


class Tree:
    """A random element, and its density figures by recursion over the whole tree."""

    def __init__(self, rng, depth=0, tag=None):
        self.tag = tag or rng.choice(["div", "section", "p", "a", "b", "ul", "li"] if depth else ["div"])
        flat = self.tag in ("p", "a", "b")
        self.parts = [" ".join(rng.choice(["alpha", "be", "gamma-delta"]) for _ in range(rng.choice([0, 1, 4, 12]))) if rng.random() < 0.6 or depth > 5 else None for _ in range(rng.randint(1, 4))]
        inline = lambda: Tree(rng, 9, rng.choice(["a", "b"])) if self.tag != "a" and depth < 9 else "x"
        block = lambda: Tree(rng, depth + 1, "li" if self.tag == "ul" else rng.choice(["div", "section", "p", "ul"]))
        self.parts = [x if x is not None else (inline() if flat else block()) for x in self.parts]

    def html(self):
        return f"<{self.tag}>" + "".join(x if isinstance(x, str) else x.html() for x in self.parts) + f"</{self.tag}>"

    def kids(self):
        return [x for x in self.parts if not isinstance(x, str)]

    def text(self):
        return "".join(x if isinstance(x, str) else x.text() for x in self.parts)

    def chars(self):
        return len("".join(self.text().split()))

    def links(self):
        return self.chars() if self.tag == "a" else sum(k.links() for k in self.kids())

    def tags(self):
        return sum(1 + k.tags() for k in self.kids())

    def link_tags(self):
        return sum((k.tag == "a") + k.link_tags() for k in self.kids())

    def density(self, share):
        c, lc, t, lt = self.chars(), max(self.links(), 1), max(self.tags(), 1), max(self.link_tags(), 1)
        if not c:
            return 0.0
        base = math.log(c / max(c - self.links(), 1) * self.links() + share * c + math.e)
        top = math.log(max(c / lc * t / lt, 1.0) + 1e-9)
        return c / t * top / math.log(base) if base > 1 + 1e-9 and math.log(base) > 1e-9 else c / t * top

    def sum(self, share):
        return sum(k.density(share) for k in self.kids()) if self.tag not in ("p", "a", "b") else 0.0

    def best(self, share):
        """The node of the largest sum, the outermost and first on a tie."""
        found = self
        for k in self.kids():
            b = k.best(share)
            if b.sum(share) > found.sum(share):
                found = b
        return found

    def lines(self, content, out, on=False):
        on = on or any(self is c for c in content)
        block = self.tag not in ("a", "b")
        out += ["\n"] * block
        for x in self.parts:
            if isinstance(x, str):
                out += [x] * on
            else:
                x.lines(content, out, on)
        out += ["\n"] * block
        return out


def test_html_density_is_brute_force():
    """Random markup: sums, article, threshold of its path and what else counts, each from its definition."""
    rng = random.Random(11)
    for _ in range(400):
        body = Tree(rng, 0, "div")
        body.tag = "body"
        share = body.links() / max(body.chars(), 1)
        top = body.best(share) if body.best(share).sum(share) > 0 else body

        def path(node, to):
            return [node] if node is to else next(([node, *p] for k in node.kids() if (p := path(k, to))), None)

        threshold, content = min(x.density(share) for x in path(body, top)), [top]

        def reach(node, threshold=threshold, content=content, share=share):
            if node.density(share) >= threshold:
                b = node.best(share)
                content.append(b if b.sum(share) > 0 else node)
                for k in node.kids():
                    reach(k)

        reach(body)
        page = html_text._Page(body.html())
        scores = html_text._Scores(page, [(i, unescape(t)) for i, t in page.pieces], page.drop)
        way = [scores.top]
        while way[-1] > scores.body:
            way.append(page.parent[way[-1]])
        assert math.isclose(scores.sums[scores.top], top.sum(share)) and scores.chars[scores.top] == top.chars(), body.html()
        assert math.isclose(min(scores.density[i] for i in way), threshold) and len(way) == len(path(body, top)), body.html()
        # The article is the block around what density says, so what that keeps is part of it; a body that is it leaves out its menus.
        if scores.top == scores.body:
            continue
        lines = [x for x in (" ".join(x.split()) for x in "".join(body.lines([top], [])).split("\n")) if x]
        got = iter(html_text.extract(body.html()).split("\n"))
        assert all(any(x == y for y in got) for x in lines), body.html()


def test_html_deep_markup_takes_linear_time():
    deep = "<b>" * 40_000 + "x" + "</i></p>" * 40_000 + "<p>y" * 1000
    start = time.time()
    assert html_text.extract(deep).startswith("x")
    assert time.time() - start < 20


def test_html_table(spark):
    d = spark.createDataFrame([(1, "u", "<p>a</p>"), (None, None, None), (1, "u", "<p>a</p>")], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.main_text(d)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert html_text.main_text(d.limit(0)).count() == 0
    assert html_text.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_warc_round_trip(spark, scratch):
    big, rng = "x" * 150, random.Random(1)
    rows = [(i, f"http://h/{i}", rng.choice([big, "small", "", None, "é\r\n\r\nWARC/1.1 " * 30, "u" * 300_000])) for i in range(40)] + [(None, "a\r\nb: c", big), (3, None, big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    made = warc.archive(pages, scratch)
    got = warc.read_archives(made).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = collections.Counter()
    for i, u, h in rows:
        again = h in first and i != first[h]
        want[None if i is None else str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if again else "response", str(first[h]) if again else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert sum(r.n_records for r in made.collect()) == len(rows)
    # The sidecar's offsets cut the archive into members that inflate alone; normalising again changes nothing.
    a = made.first()
    raw = open(a.path.removeprefix("file://"), "rb").read()
    lines = [json.loads(x) for x in open(a.index_path.removeprefix("file://"))]
    assert b"".join(raw[e["offset"] : e["offset"] + e["length"]] for e in lines) == raw
    assert all(zlib.decompress(raw[e["offset"] : e["offset"] + e["length"]], 31).startswith(b"WARC/1.1") for e in lines)
    again = warc.normalise(made.where(F.col("path") == a.path), f"{scratch.path}/again").collect()[0]
    assert open(again.path.removeprefix("file://"), "rb").read() == raw
    assert warc.archive(pages.limit(0), scratch).count() == 0


def test_warc_headers_and_cut_off_streams(spark, scratch):
    """Ids and addresses that would break a header, repeated rows, references of revisits, archives cut off between records."""
    big = "y" * 200
    rows = [("a\nb: c", " http://h/ x\r\n", big), ("  z ", None, big), ("q", "u", big), ("q", "u", big), ("é", "u", "é"), ("r", "u", "w" * 300), ("r", "u", "w" * 300), ("s", "v", "w" * 300)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(2)
    made = warc.archive(pages, scratch)
    got = warc.read_archives(made).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    kind = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kind == {("  z ", "response", None): 1, ("a\nb: c", "revisit", "  z "): 1, ("q", "revisit", "  z "): 2, ("é", "response", None): 1, ("r", "response", None): 2, ("s", "revisit", "r"): 1}
    raw = [open(r.path.removeprefix("file://"), "rb").read() for r in made.collect()]
    heads = [warc.headers(h) for x in raw for h, _ in warc.records(warc.inflate(io.BytesIO(x).read))]
    ids = [h["warc-record-id"] for h in heads]
    assert len(set(ids)) == len(rows)
    by_page = {json.loads(h["x-page-id"]): h for h in heads}
    assert by_page["a\nb: c"]["warc-refers-to"] == by_page["  z "]["warc-record-id"] and "warc-refers-to" not in by_page["s"] and by_page["s"]["warc-refers-to-target-uri"] == "u"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = z.compress(b"".join(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n" for _ in range(3)))
    whole += z.flush(zlib.Z_FULL_FLUSH)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(warc.inflate(io.BytesIO(whole).read)))
    assert len(list(warc.records(warc.inflate(io.BytesIO(whole + z.flush()).read)))) == 3


SCHEMAS = [("search", "query", "string", True), ("search", "limit", "integer", False), ("now", None, None, None)]


def chat(spark, scratch, rows):
    m = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").withColumn("call_id", F.lit("clash")).withColumn("body", F.lit("clash"))
    s = spark.createDataFrame(SCHEMAS, "name string, param string, type string, required boolean")
    return tool_calls.link(m, s, scratch)


def call(i, name, **args):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": args}) + "</tool_call>"


def result(i, content):
    return "<tool_result>" + json.dumps({"call_id": i, "content": content}) + "</tool_result>"


def test_tool_calls(spark, scratch):
    rows = [
        ("c", 1, "assistant", "Let me look. " + call("a", "search", query="x", limit=3) + call("b", "search", limit="many")), ("c", 2, "tool", result("a", {"z": 1, "b": [2]})), ("c", 3, "assistant", call("a", "now")),
        ("c", 4, "assistant", call("d", "fly")), ("c", 5, "tool", result("nobody", 1)), ("c", 6, "tool", "<tool_result>{broken</tool_result>"), ("c", 7, "user", None), ("d", 1, "tool", result("k", 1)), ("d", 2, "assistant", call("k", "now")),
        ("d", 0, "assistant", call("m", "search", query="of ${k}")), (None, 1, "assistant", call("a", "now")), ("e", 1, "assistant", call("p", "search", query="${q}") + call("q", "search", query="${p}")),
    ]
    got = chat(spark, scratch, rows).collect()
    at = {(r.conv_id, r.turn, r.kind, r.call_id): r for r in got}
    status = {k: r.status for k, r in at.items()}
    assert status["c", 1, "call", "a"] == "ok" and at["c", 1, "call", "a"].linked_turn == 2 and status["c", 1, "message", None] == "ok"
    assert status["c", 1, "call", "b"] == "invalid" and at["c", 1, "call", "b"].problems == "missing:query,type:limit"
    assert (status["c", 3, "call", "a"], status["c", 4, "call", "d"], status["c", 5, "result", "nobody"], status["c", 6, "result", None]) == ("duplicate", "unknown_tool", "orphan", "malformed")
    assert at["c", 2, "result", "a"].json == '{"call_id":"a","content":{"b":[2],"z":1},"role":"tool","type":"tool_result"}'
    assert at["c", 1, "call", "a"].json == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","role":"assistant","type":"tool_call"}'
    assert status[None, 1, "call", "a"] == "orphan" and {status["e", 1, "call", "p"], status["e", 1, "call", "q"]} == {"circular"}
    order = [(r.kind, r.call_id) for r in sorted((r for r in got if r.conv_id == "d"), key=lambda r: (r.order_turn, r.order_level, r.turn, r.part))]
    assert order == [("call", "k"), ("result", "k"), ("call", "m")]
    assert chat(spark, scratch, []).count() == 0 and at["c", 7, "message", None].json == '{"content":"","role":"user"}'


def test_tool_calls_out_of_order(spark, scratch, monkeypatch):
    """Chains, forks and circles out of order: every call comes after what it needs, in rounds that don't grow with the log."""
    n, tables = 40, []
    monkeypatch.setattr(Scratch, "write", lambda self, *a, _w=Scratch.write, **k: (tables.append(1), _w(self, *a, **k))[1])
    chain = [("c", i, "assistant", call(f"k{i}", "search", query=f"${{k{i + 1}}}" if i < n else "x")) for i in range(n + 1)] + [("c", n + 1 + i, "tool", result(f"k{i}", i)) for i in range(0, n + 1, 3)]
    fork = [("f", 1, "assistant", call("a", "search", query="${b} ${c} ${lost}")), ("f", 2, "assistant", call("b", "search", query="${d}")), ("f", 3, "assistant", call("c", "search", query="${d}")), ("f", 4, "assistant", call("d", "now")), ("f", 0, "tool", result("d", 1))]
    circle = [("e", i, "assistant", call(f"k{i}", "search", query=f"${{k{(i + 1) % 5}}}")) for i in range(5)] + [("e", 6, "assistant", call("after", "search", query="${k2}")), ("e", 7, "assistant", call("free", "now"))]
    got = [r for r in chat(spark, scratch, chain + fork + circle).collect() if r.kind != "message"]
    place = {(r.conv_id, r.kind, r.call_id): (r.order_turn, r.order_level, r.turn, r.part) for r in got}
    for (conv, kind, i), at in place.items():
        if kind == "result":
            assert place[conv, "call", i] < at
    for i in range(n):
        assert place["c", "result" if ("c", "result", f"k{i + 1}") in place else "call", f"k{i + 1}"] < place["c", "call", f"k{i}"]
    assert place["f", "result", "d"] < min(place["f", "call", "b"], place["f", "call", "c"]) and max(place["f", "call", "b"], place["f", "call", "c"]) < place["f", "call", "a"]
    assert {r.call_id for r in got if r.status == "circular"} == {"k0", "k1", "k2", "k3", "k4", "after"} and place["e", "call", "k3"] == (3, 0, 3, 0)
    assert len(tables) < 40


def test_tool_calls_wrappers_and_repeats(spark, scratch):
    """Closing tags inside JSON strings, broken JSON, long texts, repeated rows."""
    tricky, long = 'a </tool_call> b \\" </tool_result> {"', "x" * 300_000
    rows = [("c", 1, "assistant", "so " + call("a", "search", query=tricky) + " then " + call("b", "now")), ("c", 2, "tool", result("a", tricky)), ("c", 3, "assistant", '<tool_call>{"id": "z</tool_call> and <tool_call>{"id":"y","name":"now"}</tool_call>'), ("c", 4, "tool", result("b", long)), ("c", 4, "tool", result("b", long)), ("c", 5, "user", long)]
    got = chat(spark, scratch, rows).collect()
    calls = {r.call_id: r for r in got if r.kind == "call"}
    assert json.loads(calls["a"].json)["arguments"] == {"query": tricky} and calls["a"].linked_turn == 2 and calls["b"].status == "ok"
    assert json.loads(next(r for r in got if r.call_id == "a" and r.kind == "result").json)["content"] == tricky
    assert [r.json for r in got if r.turn == 1 and r.kind == "message"] == ['{"content":"so  then","role":"assistant"}']
    assert {r.status for r in got if r.turn == 3} == {"malformed", "ok", "unanswered"}
    assert [(r.status, len(r.json) > 300_000) for r in got if r.turn == 4] == [("ok", True)] * 2 and len([r for r in got if r.turn == 5]) == 1


def test_tool_call_query_has_every_case(spark):
    got = QUERIES["op6_tool_calls"](spark, "/root/testdata/sf0.01").collect()
    status = collections.Counter((r.kind, r.status) for r in got)
    assert {("call", s) for s in ("ok", "invalid", "unknown_tool", "duplicate", "unanswered", "circular")} | {("result", s) for s in ("ok", "orphan", "duplicate", "malformed", "circular")} | {("message", "ok")} <= set(status)
    assert any(r.order_level > 0 for r in got)


def test_classifier(spark, scratch):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(rng.randint(40, 90))) + "."
    bad = lambda: " ".join(rng.choice(["###", "a$$", "9%9", "x"]) for _ in range(rng.randint(20, 60)))
    rows = [(i, good() if i % 3 else bad()) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(5, None), (None, 1)], "doc_id bigint, quality int")
    docs = texts(spark, rows + [(700, None), (701, ""), (None, "x")])
    got = {r.doc_id: r for r in quality_classifier.score(docs, labels, scratch).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in range(600)) and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].predicted == int(i % 3 > 0) for i in held) >= 0.95 * len(held) and not got[None].held_out
    assert {r.score for r in quality_classifier.score(docs, labels.limit(0), scratch).collect()} == {0.5}
    assert quality_classifier.score(texts(spark, []), labels, scratch).count() == 0


def plain_features(t):
    """FEATURES from their definitions, one text at a time."""
    w = WORD.findall((t or "").translate(LOWER))
    n, raw = max(len(w), 1), (t or "").encode()
    words = WORD.findall(t or "")
    lines = (t or "").split("\n")
    with_word = [x for x in lines if WORD.search(x)]
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    alpha = sum(c.isascii() and c.isalpha() for c in t or "")
    return [
        math.log1p(len(w)), min(sum(map(len, words)) / n, 30), min(sum(c in "#*$%&|<>" for c in t or "") / n, 3), (len(with_word) - len(set(with_word))) / len(lines), len(repeated) / n,
        1 - (len(w) - len(set(w))) / n, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, sum("A" <= c <= "Z" for c in t or "") / max(alpha, 1), sum(48 <= b < 58 for b in raw) / max(len(raw), 1),
        min(sum(c in ".,;:!?" for c in t or "") / n, 3), sum(b >= 128 for b in raw) / max(len(raw), 1), math.log1p(len(w) / len(lines)),
    ]


def test_classifier_is_brute_force(spark, scratch):
    """Scores against the definition on all rows at once: standardised statistics, cosines, ridge on three folds, isotonic map by the max-min formula on the fourth."""
    rng = random.Random(5)
    rows = [(i, t) for i, t in corpus(7, 260) if i is not None]
    rows += [(3, rows[3][1]), (7, rows[7][1])]
    labels = [(i, int(rng.random() < (0.8 if len(t or "") > 400 else 0.3))) for i, t in rows[:240]] + [(5, 1), (6, None)]
    got = quality_classifier.score(texts(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int"), scratch).collect()
    x = np.array([plain_features(t) for _, t in rows])
    assert np.abs(quality_classifier.features(pa.array([t for _, t in rows])) - x).max() < 1e-12
    scale = x.std(0)
    z = (x - x.mean(0)) / np.where(scale > 0, scale, 1)
    draw = np.random.default_rng(quality_classifier.SEED)
    w, b = draw.normal(0, 1 / quality_classifier.WIDTH, (x.shape[1], quality_classifier.COSINES)), draw.uniform(0, 2 * np.pi, quality_classifier.COSINES)
    c = np.hstack([np.ones((len(z), 1)), np.sqrt(2 / quality_classifier.COSINES) * np.cos(z @ w + b)])
    y = {i: np.mean([v for k, v in labels if k == i and v is not None]) for i in {k for k, v in labels if v is not None}}
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i, _ in rows])
    known = np.array([i in y for i, _ in rows])
    fit, cal = known & (fold > 0) & (fold < 4), known & (fold == 4)
    target = np.array([y.get(i, 0.0) for i, _ in rows])
    k = quality_classifier.COSINES
    beta = np.linalg.solve(c[fit].T @ c[fit] + quality_classifier.RIDGE * fit.sum() * np.diag(np.r_[0, np.ones(k)] / k) + 1e-9 * np.eye(k + 1), c[fit].T @ target[fit])
    raw = np.clip(c @ beta, 0, 1)
    bins = np.floor(raw * quality_classifier.BINS + 0.5)
    at = sorted(set(bins[cal]))
    n, hits = [sum(bins[cal] == e) for e in at], [target[cal][bins[cal] == e].sum() for e in at]
    level = [max(min(sum(hits[a : z + 1]) / sum(n[a : z + 1]) for z in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    pools = [(np.average([at[i] for i in g], weights=[n[i] for i in g]) / quality_classifier.BINS, v) for v in sorted(set(np.round(level, 12))) for g in [[i for i in range(len(at)) if round(level[i], 12) == v]]]
    want = dict(zip([i for i, _ in rows], np.interp(raw, *zip(*pools, strict=True)), strict=True))
    assert len(got) == len(rows) and max(abs(r.score - want[r.doc_id]) for r in got) < 1e-6


def test_quality_ledger_of_a_text_of_many_slices(spark):
    long = "\n".join(f"line {i % 50_000} of {i % 7} words" for i in range(120_000))
    r = quality_rules.ledger(texts(spark, [(1, long), (2, "x y z"), (2, "x y z")])).collect()
    m = next(x.quality_ledger for x in r if x.doc_id == 1)
    assert len(long) > 2 << 20 and (m.n_lines, m.n_words, m.n_dup_lines) == (120_000, 600_000, 120_000 - len(set(long.split("\n")))) and len(r) == 3


def test_isotonic():
    edges, values = quality_classifier.pool(np.array([0.1, 0.2, 0.3]), np.array([1, 0, 3]), np.array([2.0, 2.0, 3.0]))
    assert values.tolist() == [0.25, 1.0] and edges.tolist() == pytest.approx([0.15, 0.3])


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], SMALL)
