"""Text operators against plain single-process versions, on small frames with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import decontamination, neardup, packing, sanitise, substring_dedup, token_counts

SCHEMA = "doc_id long, text string, row string, n_words int, spans int, component_id string"
RND = random.Random(11)
WORDS = [f"w{i}" for i in range(300)] + ["Überß", "日本", "a👍b", "x@y.org", "+1 555 010 9999", "4111 1111 1111 1111"]


def _text(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


BASE = [_text(120) for _ in range(6)]


def _edited(text, n):
    words = text.split()
    for _ in range(n):
        words[RND.randrange(len(words))] = RND.choice(WORDS)
    return " ".join(words)


TEXTS = (
    [(i, b) for i, b in enumerate(BASE)]
    + [(10 + i, BASE[i % 6]) for i in range(20)]
    + [(40 + i, _edited(BASE[i % 6], 1 + i % 4)) for i in range(40)]
    + [(100, None), (101, ""), (102, "  \n\t"), (103, "one two"), (104, "one two"), (105, "ONE two"), (None, BASE[0]),
       (None, None), (106, _text(6000)), (106, BASE[1]), (3, BASE[3]), (107, "x" * 5000), (108, "\x00é\x1c ｆ")]
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "r", 1, 2, "c") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(frame, *names):
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=str)


def _base_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


ITEMS = [("7", " ".join(BASE[2].split()[10:40])), ("10", "one TWO"), ("b", "日本"), ("n", None), (None, BASE[1]), ("e", ""),
         ("7", " ".join(BASE[2].split()[10:40])), ("z", " ".join(BASE[4].split()[:13]) + " w1")]


@pytest.mark.parametrize("block_words", [200_000, 3])
def test_contamination(spark, docs, empty, block_words):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = decontamination.decontaminate(docs, bench, keep=["doc_id"], block_words=block_words)
    got = _rows(got, "row.doc_id", "n_words", "n_hit", "items", "contaminated")
    windows = defaultdict(set)
    for item, text in ITEMS:
        words = _base_words(text)
        if words and item is not None:
            size = min(13, len(words))
            for i in range(len(words) - size + 1):
                windows[tuple(words[i : i + size])].add(item)
    want = []
    for doc_id, text in TEXTS:
        words, hit, found = _base_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if items := windows.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= items
        want.append((doc_id, len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)))
    assert got == sorted(want, key=str)
    assert decontamination.decontaminate(empty, bench).count() == 0
    none = decontamination.decontaminate(docs, bench.where("false"))
    assert none.where("contaminated or n_hit > 0").count() == 0 and none.select("row.*").columns == docs.columns


def test_cut_runs(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    cut = decontamination.decontaminate(docs, bench, cut=True)
    again = cut.where("contaminated").select(F.col("row.doc_id").alias("doc_id"), F.col("clean_text").alias("text"))
    assert again.count() and decontamination.decontaminate(again, bench.where("item_id = '7'")).agg(F.max("n_hit")).first()[0] == 0
    assert cut.where("not contaminated and not (clean_text <=> row.text)").count() == 0


def test_token_counts(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = _rows(token_counts.count_tokens(docs, path, limit=100), "row.doc_id", "n_bytes", "n_tokens", "over_limit")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 100) for i, t in TEXTS]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(empty, path).count() == 0
    counter, signs = token_counts.MergeCounter(path), "ab \n\t\ré▁<>|'s日👍0.,;{}́ "
    for _ in range(2000):
        text = "".join(RND.choice(signs) for _ in range(RND.randrange(40)))
        assert counter.count(text, {}) == len(model.encode(text)), repr(text)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, capacity=512, group_bytes=20_000).collect()
    whole = defaultdict(int)
    for _, text in TEXTS:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        whole[tuple(ids)] += 1
    by_sequence, made = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u2")
        assert len(ids) == p.length and zlib.crc32(ids.astype("<u4").tobytes()) == p.ids_crc32
        by_sequence[p.sequence_id].append(p)
        made[p.doc_id, p.doc_tokens].append((p.start, ids.tolist()))
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        assert sum(p.length for p in parts) <= 512
    total = sum(len(ids) * n for ids, n in whole.items())
    assert sum(p.length for p in pieces) == total
    texts = {i: t for i, t in TEXTS}
    for (doc_id, size), parts in made.items():
        if doc_id is not None and [i for i, _ in TEXTS].count(doc_id) == 1:
            ids = [x for _, some in sorted(parts) for x in some]
            assert ids == [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2] and len(ids) == size
    assert packing.pack(empty, path).count() == 0
    # little padding, and costs alike
    lengths = np.sort(np.random.default_rng(1).integers(1, 4000, 3000))[::-1]
    cost, room = defaultdict(float), defaultdict(int)
    for _, _, size, to, offset in packing.placed(lengths, 4096, packing.LINEAR, packing.QUADRATIC):
        assert offset == room[to]
        room[to] += size
        cost[to] += size + size * size / 4096
    assert len(room) * 4096 - sum(room.values()) < 4096 and max(room.values()) <= 4096
    assert np.percentile(list(cost.values()), 90) < 1.6 * np.median(list(cost.values()))


def _shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def test_near_duplicates(spark, docs, empty):
    got = _rows(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    nodes = {i for i, _ in TEXTS if i is not None}
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, _shingles(t)) for i, t in TEXTS]
    for (i, a), (j, b) in combinations([x for x in sets if x[0] is not None and x[1]], 2):
        if 100 * len(a & b) >= 85 * len(a | b):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    want = [(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets]
    assert got == sorted(want, key=str)
    assert neardup.near_duplicates(empty).count() == 0


def test_every_pair_under_the_signature_distance_shares_a_key(spark):
    rng = np.random.default_rng(2)
    one = rng.integers(0, 1 << 16, neardup.SYMBOLS)
    rows = [(0, one.tolist())]
    for i in range(1, 60):
        other = one.copy()
        other[rng.choice(neardup.SYMBOLS, neardup.DISTANCE, replace=False)] += 1
        rows.append((i, other.tolist()))
    keys = neardup.keys_of(spark.createDataFrame(rows, "node long, symbols array<int>")).toPandas()
    mine = set(keys[keys.node == 0].key)
    assert all(mine & set(keys[keys.node == i].key) for i in range(1, 60))


def test_repeated_strings(docs, empty, monkeypatch):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    owner, age = {}, lambda i: (i is None, i or 0)
    raw = [(i, (t or "").encode()) for i, t in TEXTS]
    for i, b in raw:
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            owner[s] = min(owner.get(s, age(i)), age(i))
    want = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if owner[b[p : p + 50]] < age(i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        want.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    for block, piece in ((8 << 20, 2 << 20), (3000, 200)):
        monkeypatch.setattr(substring_dedup, "PIECE_BYTES", piece)
        out = substring_dedup.removed(docs, block_bytes=block)
        assert _rows(out, *names) == sorted(want, key=str)
    assert substring_dedup.removed(empty).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and total % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{sanitise.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_personal_data(spark, docs, empty):
    signs = "ab@..-_0123 +()é👍\n9 4"
    odd = [(i, "".join(RND.choice(signs) for _ in range(RND.randrange(60)))) for i in range(800)]
    odd += [(901, "a@b" + ".c" * 30000), (902, "1" * 50000), (903, "x@b.c_d@e.f x@b..c@d.e"), (None, "a@b.cc"), (904, None),
            (905, "256.1.1.1.1 000255.0.0.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +44 (20) 7946.0958")]
    frame = spark.createDataFrame(odd, "doc_id long, text string")
    for source, rows in ((frame, odd), (docs, TEXTS)):
        got = _rows(sanitise.personal_data(source), "doc_id", sanitise.listed(F.col("base")))
        assert got == sorted([(i, _base(t)) for i, t in rows], key=str)
    assert sanitise.personal_data(empty).count() == 0 and sanitise.sanitised(empty).columns == docs.columns


def test_revealing_terms(spark):
    plain = [(i, f"common words stand here {i}") for i in range(40)]
    told = [(100 + i, f"note {i} Zorbla wrote from ann@example.org common words {i}") for i in range(4)]
    frame = spark.createDataFrame(plain + told, "doc_id long, text string")
    out = {r.doc_id: r.text for r in sanitise.sanitised(frame).collect()}
    assert all("ann@" not in t and "Zorbla" not in t for t in out.values())
    assert "common words" in out[100] and "[TERM]" in out[100] and "[EMAIL]" in out[100]
    assert all(out[i] == t for i, t in plain)
    spans = {r.doc_id: r.s for r in sanitise.personal_data(frame).select("doc_id", sanitise.listed(F.col("spans")).alias("s")).collect()}
    assert "term:7:13" in spans[101] and "email" in spans[101]


def _terms_by_hand(rows):
    """The places of revealing terms, straight from the definition."""
    bases, words = [], []
    for _, text in rows:
        spans = [x.split(":") for x in _base(text).split(",") if x]
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        clear = "".join(" " if any(a <= i < b for _, a, b in spans) else c for i, c in enumerate(text or ""))
        bases.append({(k, text[a:b].lower()) for k, a, b in spans})
        words.append([(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", clear)])
    held, kinds, d_term = defaultdict(set), defaultdict(set), defaultdict(int)
    for i, base in enumerate(bases):
        for e in base:
            held[e].add(i)
        for w in {w for _, _, w in words[i]}:
            d_term[w] += 1
    few = lambda at, least: len({rows[i][1] for i in at}) < least
    for e, at in held.items():
        if few(at, 3):
            kinds[e[0]] |= at
    out = defaultdict(set)

    def judge(at, candidates, min_texts, bits):
        content = math.log2(len(rows) / len(at))
        for w in {w for i in at for _, _, w in words[i]} & candidates:
            both = {i for i in at if any(w == x for _, _, x in words[i])}
            told = math.log2(len(both) * len(rows) / (d_term[w] * len(at)))
            if content > 0 and told >= content * 0.9 and not few(both, min_texts) and len(both) * content >= bits:
                for i in both:
                    out[i] |= {(a, b) for a, b, x in words[i] if x == w}

    for e, at in held.items():
        if not few(at, 3):
            judge(at, set(d_term), 3, 0)
        judge(at, set(re.findall(r"[^\W\d_]{3,}", e[1])) & set(d_term), 1, 0)
    for at in kinds.values():
        judge(at, set(d_term), 3, 20)
    return [",".join(f"term:{a}:{b}" for a, b in sorted(out[i])) for i in range(len(rows))]


def test_revealing_terms_of_whole_documents_and_rare_entities(spark):
    rnd = random.Random(5)
    fill = lambda n: " ".join(rnd.choice(["alpha", "Beta", "gamma", "été", "👍", "of"]) for _ in range(n))
    rows = [(i, f"{fill(30)} plain{'abcdefghij'[i % 10] * 3} cell") for i in range(300)]
    # far from the match, twice, and in three texts
    rows += [(400 + i, f"Quorvex {fill(900)} eve@site.net {fill(900)} quorvex {i}") for i in range(3)]
    # one text each: the kind has a term of its own, each address its own words
    rows += [(500 + i, f"Miller{'abcdefgh'[i]} {fill(40)} reachable {fill(40)} x.miller{'abcdefgh'[i]}@site.net once{'abcdefgh'[i] * 2}") for i in range(8)]
    rows += [(None, rows[-1][1]), (None, rows[-1][1]), (600, None), (601, ""), (602, "cell 10.0.0.1 +44 20 7946 0958")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    terms = F.filter("spans", lambda s: s["kind"] == 4)
    got = _rows(sanitise.personal_data(frame), "doc_id", sanitise.listed(terms))
    assert got == sorted([(r[0], t) for r, t in zip(rows, _terms_by_hand(rows))], key=str)
    safe = {r.doc_id: r.text for r in sanitise.sanitised(frame).collect()}
    assert safe[400].count("[TERM]") == 2 and "uorvex" not in safe[400]
    assert safe[500].startswith("[TERM] ") and "iller" not in safe[500] and "reachable" not in safe[500] and "onceaa" in safe[500]
    assert safe[0] == rows[0][1]


def test_words_beyond_a_piece(spark):
    text = "é👍 " * 1500 + "x" * 9000 + " 1 " + "word, " * 2000
    out = spark.createDataFrame([(text,), ("",)], "t string").select(sanitise._words(F.col("t")).alias("w")).collect()
    assert [(w.start, w.end, w.term) for w in out[0].w] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[a-z]{3,}", text)]
    assert out[1].w == []
