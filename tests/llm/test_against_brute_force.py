"""Every registered query against a plain computation over the same rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {code: code + 32 for code in range(65, 91)}


@pytest.fixture(scope="module")
def ids(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [text or "" for _, text in docs]
    coded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return {doc_id: found.ids for (doc_id, _), found in zip(docs, coded)}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(result, ids):
    start, expected = 0, []
    for doc_id in sorted(ids):
        own = [*ids[doc_id], 2]
        expected.append((doc_id, start, len(own), crc(own)))
        start += len(own)
    found = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in result("op1_elias_fano")]
    assert sorted(found) == expected


def test_op2(result, docs, spark, data_dir):
    found = {r["doc_id"]: r for r in result("op2_language")}
    assert len(found) == len(docs)
    declared = dict(spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "lang").collect())
    right = [found[doc_id]["language"] == declared[doc_id] for doc_id, _ in docs]
    assert np.mean(right) > 0.98
    assert np.mean([r["accepted"] for r in found.values()]) > 0.98


def shingles(text, width):
    words = SPACE_WORDS.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def linked(sets, percent):
    names = {doc_id: doc_id for doc_id in sets}

    def top(x):
        while names[x] != x:
            x = names[x]
        return x

    holders = defaultdict(set)
    for doc_id, own in sets.items():
        for shingle in own:
            holders[shingle].add(doc_id)
    for doc_id, own in sets.items():
        for other in set().union(*[holders[s] for s in own]) if own else ():
            shared = len(own & sets[other])
            if 100 * shared >= percent * (len(own) + len(sets[other]) - shared):
                a, b = sorted((top(doc_id), top(other)))
                names[b] = a
    return {doc_id: top(doc_id) for doc_id in sets}


def test_op3(result, docs):
    sets = {doc_id: shingles(text, 3) for doc_id, text in docs}
    names = linked(sets, 85)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in result("op3_minhash")}
    assert found == {i: (len(sets[i]), names[i], names[i] == i) for i in sets}
    assert len(set(names.values())) < len(names)


def test_op4(result, ids):
    pieces, used = defaultdict(list), defaultdict(list)
    for r in result("op4_packing"):
        own = [*ids[r["doc_id"]], 1]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for doc_id, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[doc_id]) + 1
    sizes = []
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        sizes.append(at)
    assert sum(sizes) / (2048 * len(sizes)) > 0.95
    assert set(used) == set(range(len(used)))


FORMS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
]


def base_spans(text):
    found = []
    for place, (kind, form) in enumerate(FORMS):
        for match in form.finditer(text or ""):
            size = len(match[2]) if kind == "assign" else len(match[0])
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                found.append((match.start(), place, kind, match.end()))
    return sorted(found)


def test_op5(spark):
    from braidgraph.llm import queries

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in queries.QUERIES["op5_secrets"](spark, folder).collect()}
    some = 0
    for doc_id, text in docs:
        spans, row = base_spans(text), found[doc_id]
        joined = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)
        assert row["base_sha256"] == sha(joined)
        counts = [sum(s[2] == kind for s in spans) for kind, _ in FORMS]
        assert counts == [row["n_assign"], row["n_access"], row["n_hex"]]
        assert set(joined.split(",") if joined else []) <= set(row["spans"].split(","))
        some += len(spans)
    assert some


def repeats(docs, width):
    words = {doc_id: SPACE_WORDS.findall(text or "") for doc_id, text in docs}
    first = {}
    for doc_id in sorted(words):
        own = words[doc_id]
        for i in range(len(own) - width + 1):
            first.setdefault(tuple(own[i : i + width]), doc_id)
    result = {}
    for doc_id, own in words.items():
        gone = set()
        for i in range(len(own) - width + 1):
            if first[tuple(own[i : i + width])] < doc_id:
                gone.update(range(i, i + width))
        kept = [word for i, word in enumerate(own) if i not in gone]
        result[doc_id] = (len(own), len(gone), sha(" ".join(kept)))
    return result


def test_op6(result, docs):
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in result("op6_substring")}
    assert found == repeats(docs, 50)
    assert sum(row[1] for row in found.values())


def contaminated(docs, items, span=10):
    windows = defaultdict(set)
    for item_id, text in items:
        words = BENCH_WORDS.findall((text or "").translate(LOWER))
        size = min(span, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[i : i + size])].add(str(item_id))
    sizes = {len(window) for window in windows}
    result = {}
    for doc_id, text in docs:
        words = BENCH_WORDS.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (found := windows.get(tuple(words[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    names |= found
        result[doc_id] = (len(words), len(hit), len(names), sha(",".join(sorted(names))))
    return result


def test_op7(result, docs, spark, data_dir):
    items = spark.read.parquet(f"{data_dir}/benchmark.parquet").select("item_id", "text").collect()
    expected = contaminated(docs, [tuple(item) for item in items])
    found = {
        r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"])
        for r in result("op7_winnowing")
    }
    assert found == expected
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in result("op7_winnowing"))
    assert any(row[1] for row in found.values())


def test_op8(result, spark, data_dir):
    rows = spark.read.parquet(f"{data_dir}/embeddings.parquet").collect()
    keys = np.array([row["vec_id"] for row in rows])
    whole = np.floor(256 * np.array([row["embedding"] for row in rows], np.float64)).astype(np.int64)
    expected = []
    for query in np.flatnonzero(keys % 50 == 0):
        scores = whole @ whole[query]
        best = sorted((-scores[i], keys[i]) for i in range(len(keys)) if i != query)[:5]
        expected += [(keys[query], rank + 1, key, -score) for rank, (score, key) in enumerate(best)]
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in result("op8_kdtree")]
    assert sorted(found) == sorted(expected)


def auc(scores, marks):
    order = np.argsort(np.argsort(scores))
    ones = marks.sum()
    return (order[marks == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(marks) - ones))


@pytest.mark.parametrize(
    "name, label, parts, remainder, threshold, least",
    [("op9_compression", "quality", 3, 1, 0.5, 0.95), ("op10_toxicity", "toxic", 4, 2, 0.3, 0.95)],
)
def test_classifiers(spark, name, label, parts, remainder, threshold, least):
    from braidgraph.llm import queries

    folder = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, folder).collect()
    marks = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", label).collect())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == remainder)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    held = [r for r in rows if r["held_out"] and marks.get(r["doc_id"]) is not None]
    found = auc(np.array([r["score"] for r in held]), np.array([marks[r["doc_id"]] for r in held]))
    assert found > least
