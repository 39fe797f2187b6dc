"""Spelling variants, aligned tokenizers and repeated bytes against plain computations."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from braidgraph.llm import alignment, phrases, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {code: code + 32 for code in range(65, 91)}


def plain_words(docs, slip=97):
    counts = Counter()
    for doc_id, text in docs:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 5 and n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    first = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[first + 1 :] == b[first + 1 :]
    a, b = sorted((a, b), key=len)
    return a[first:] == b[first + 1 :]


def plain_variants(words):
    by_size = defaultdict(list)
    for word in words:
        by_size[len(word)].append(word)
    form, count = {}, {}
    for word, n in words.items():
        others = [o for d in (-1, 0, 1) for o in by_size[len(word) + d] if near(word, o)]
        count[word] = len(others)
        best = min(((-words[o], o) for o in others), default=(0, None))
        form[word] = best[1] if -best[0] >= 2 * n else None

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word

    return sorted(
        (w, form[w], root(w), n, count[w], words.get(form[w])) for w, n in words.items()
    )


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


def test_op11(result, docs):
    found = sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in result("op11_spelling"))
    assert found == plain_variants(plain_words(docs))


@pytest.mark.parametrize("seed", range(3))
def test_variants_of_words_over_few_letters(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))): rng.randrange(1, 40) for _ in range(400)}
    words |= {"a" * size: size for size in range(5, 12)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(table)) == sorted(plain_variants(words), key=repr)


def test_pivots_are_the_least_disjoint_pair():
    rng = random.Random(3)
    for _ in range(300):
        ranks = [rng.randrange(6) for _ in range(rng.randrange(4, 12))]
        last = sorted(ranks)[2]
        prefix = [i for i, rank in enumerate(ranks) if rank <= last]
        every = [(ranks[a] + ranks[b], a, b) for a in prefix for b in prefix if b >= a + 2]
        a, b = spelling.pivots(ranks, prefix)
        assert b >= a + 2 and ranks[a] + ranks[b] == min(every)[0]


def test_spelling_of_odd_rows(spark, odd, nothing):
    assert spelling.spelling_variants(nothing).count() == 0
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(spelling.spelling_variants(odd)) == plain_variants(plain_words(rows))
    rows = [(i, "Straße Strasse straße Ñandú ñandú " * 2, "x", 1.0) for i in (1, 1, 2)] + [(None, "straße " * 9, "y", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n double")
    found = rows_of(spelling.spelling_variants(docs))
    assert found == sorted(plain_variants(plain_words([row[:2] for row in rows])), key=repr)
    assert any(word == "straße" for word, *_ in found)


@pytest.fixture(scope="module")
def coded():
    """The tokens of both sides as (ids, bytes); None where a side doesn't give the text back."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(byte): byte for byte in shown}
    byte_of |= {chr(256 + i): byte for i, byte in enumerate(x for x in range(256) if x not in shown)}
    entries = {token: bytes(byte_of.get(c, 63) for c in entry) for entry, token in a.get_vocab().items()}

    def of(text):
        data = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_b = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in ids_b
        ]
        bytes_a = [entries[i] for i in ids_a]
        if not text or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            return None
        return ids_a, bytes_a, ids_b, bytes_b

    return of


def spans(parts):
    end, found = 0, []
    for part in parts:
        found.append((end, end + len(part)))
        end += len(part)
    return found


def plain_alignment(docs, coded):
    counts, held = Counter(), []
    for doc_id, text in docs:
        sides = coded(text) if text else None
        if sides is None:
            held.append((doc_id, None))
            continue
        ids_a, bytes_a, ids_b, bytes_b = sides
        spans_a, spans_b = spans(bytes_a), spans(bytes_b)
        links, low = [], 0
        for (start, end), a in zip(spans_a, ids_a):
            while spans_b[low][1] <= start:
                low += 1
            at = low
            while at < len(spans_b) and spans_b[at][0] < end:
                links.append((ids_b[at], a))
                at += 1
        groups, i, j = [], 0, 0
        for cut in sorted({e for _, e in spans_a} & {e for _, e in spans_b}):
            x = next(k for k in range(i, len(spans_a)) if spans_a[k][1] == cut) + 1
            y = next(k for k in range(j, len(spans_b)) if spans_b[k][1] == cut) + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            i, j = x, y
        counts.update(links)
        held.append((doc_id, (len(ids_a), len(ids_b), len(groups), links, ";".join(groups))))
    most = Counter()
    for (b, _), n in counts.items():
        most[b] = max(most[b], n)
    found = []
    for doc_id, own in held:
        if own is None:
            found.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = own
        best = sum(counts[link] == most[link[0]] for link in links)
        digest = hashlib.sha256(groups.encode()).hexdigest()
        found.append((doc_id, n_a, n_b, n_groups, len(links), best, sum(counts[x] for x in links), digest))
    return sorted(found, key=repr)


ODD_TEXTS = [
    "a  b ﬁ  ", "\nword\n\n x", "  two", "<s>hi</s><unk>", "tab\tx", "<0x41>", "▁x", " ", "\n",
    "a　b", "é́", "\xa0x", "a\x00b", "x \r\n y", "x);\r\ny", "<|endoftext|>ab<|endoftext|> cd",
    "", "\U0001f642 é\n\nz  ", "a\n b\nc d ", "\r", "  ", "x\t\n y z", None, "'s ''ll don't",
    "漢字かな\n漢", "word," * 300, "a b\n" * 200 + "c",
]


def test_op12(result, docs, coded):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = sorted((tuple(r[c] for c in names) for r in result("op12_alignment")), key=repr)
    assert found == plain_alignment(docs, coded)


def test_alignment_of_odd_texts(spark, odd, nothing, coded):
    docs = [(i if i % 5 else None, text) for i, text in enumerate(ODD_TEXTS)] + [(3, "a b"), (3, "a b")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.align_tokenizers(table)) == plain_alignment(docs, coded)
    rows = odd.select("doc_id", "text").collect()
    assert rows_of(alignment.align_tokenizers(odd)) == plain_alignment([tuple(r) for r in rows], coded)
    assert alignment.align_tokenizers(nothing).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(alignment.align_tokenizers(empty)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def plain_removal(docs, width=100):
    """Rows of one id are one document: what starts at the same place is no repetition."""
    first = {}
    texts = [(doc_id, (text or "").encode()) for doc_id, text in docs]
    for doc_id, data in texts:
        for at in range(len(data) - width + 1) if doc_id is not None else ():
            key = data[at : at + width]
            first[key] = min(first.get(key, (doc_id, at)), (doc_id, at))
    found = []
    for doc_id, data in texts:
        gone = bytearray(len(data))
        for at in range(len(data) - width + 1) if doc_id is not None else ():
            if first[data[at : at + width]] < (doc_id, at):
                gone[at : at + width] = b"\1" * width
        n_spans = len(re.findall(b"\1+", bytes(gone)))
        left = bytes(byte for byte, out in zip(data, gone) if not out)
        found.append((doc_id, len(data), sum(gone), n_spans, hashlib.sha256(left).hexdigest()))
    return sorted(found, key=repr)


def test_op13(result, docs):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = sorted((tuple(r[c] for c in names) for r in result("op13_phrases")), key=repr)
    assert found == plain_removal(docs)


@pytest.mark.parametrize("hot", [phrases.HOT, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_removal_of_spliced_texts(spark, seed, hot):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab \x00é") for _ in range(rng.randrange(40, 260))) for _ in range(8)]
    docs = [
        (1, ""), (2, None), (3, "a" * 700), (4, "ab" * 300), (5, "a" * 99), (6, "a" * 100), (None, "a" * 300),
        (7, "x" * 200), (7, "x" * 200), (8, "\x00" * 400), (9, "\x00" * 150 + "a"), (7, "x" * 150 + "y" * 120),
    ]
    for doc_id in range(10, 60):
        text = "".join(rng.choice(base)[rng.randrange(30) :] for _ in range(rng.randrange(1, 6)))
        if rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + "Z" + text[at + 1 :]
        docs.append((doc_id, text))
    rng.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows_of(phrases.remove_repeated_bytes(table, hot=hot)) == plain_removal(docs)


def test_removal_of_odd_rows(spark, odd, nothing):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(phrases.remove_repeated_bytes(odd)) == plain_removal(rows)
    assert phrases.remove_repeated_bytes(nothing).count() == 0
    kept = phrases.remove_repeated_bytes(odd.filter("doc_id = 4"), with_text=True).first()["kept"]
    assert hashlib.sha256(kept).hexdigest() == phrases.remove_repeated_bytes(odd.filter("doc_id = 4")).first()["kept_sha256"]
    with pytest.raises(ValueError):
        phrases.remove_repeated_bytes(odd, width=phrases.TRIGGER)
