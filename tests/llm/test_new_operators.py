"""Conversation trie, token counts and ranked search against brute force, with nulls, empty,
repeated and very long texts, ties, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablelens.llm import prefix_trie, queries, ranked_search, token_counts

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trie_of(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda r: r[0])] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    members, children = {}, {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in below)
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def built(frame):
    nodes, ends = prefix_trie.build(frame)
    found = nodes.join(prefix_trie.end_digests(ends), "node", "left").fillna({"ends_sha256": hashlib.sha256(b"").hexdigest()})
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.select(*names).collect()), key=str)


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 2)  # running aggregates cross slices
    rng, rows = random.Random(5), []
    for c in [*range(45), -5, -25, -40, 99999999999]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 5, 9, 30])):
            turn = None if t == 0 and c % 3 == 0 else t
            rows.append((c, turn, rng.choice(["user", None, "a"]), rng.choice(["x y", "", None, "z  z\tq"]), "clash", b"x", 1))
    rows += [(200, t, "user", "same turn " * 3, "", b"", 0) for t in range(60)]  # one long conversation
    rows += [(300 + k, t, "user", "a common start", "", b"", 0) for k in range(30) for t in range(4)]  # copies
    rows.append((None, 1, "user", "of no conversation", "", b"", 0))
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, node string, id binary, depth int")
    assert built(frame) == trie_of([r[:4] for r in rows])
    assert built(frame.limit(0)) == []


def test_trie_of_repeated_turns_and_long_texts(spark):
    rows = [(7, None, None, None)] * 3 + [(7, 1, "u", "w " * 200_000), (8, 1, "u", "w " * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    assert built(frame) == trie_of(rows)


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    texts = [
        None, "", " \t\n", "<|endoftext|>a <|startoftext|><|endoftext|>", "<|END|> <|endoftext|", "I'LL don't 'S we're ÀÉ ΑΣ ΣΑΣ. Ⱥb",
        "éá̧ ́x", "12345 ½ ² x_y", "漢字 かな 한글 😀👍🏽", "a" * 5000, "word " * 30_000, "\x1c\x85\xa0 z",
    ]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x52F), rng.randrange(0x530, 0xD7FF)])) for _ in range(60)) for _ in range(60)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "no id", 0), (0, None, 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted(map(tuple, token_counts.count_tokens(frame, WORDS, limit=2048).collect()), key=str)
    want = []
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(frame.limit(0), WORDS, limit=1).count() == 0


def test_splitting_of_every_code_point_below_the_fast_limit(monkeypatch):
    splitter = token_counts.Splitter(WORDS)
    assert splitter.fast
    for cp in range(token_counts.FAST):
        for text in (chr(cp), f"a{chr(cp)}b1", f"Σ{chr(cp)} 's{chr(cp)}", f"a{chr(cp)}̣́"):
            assert splitter.split(text) == splitter._own(text), hex(cp)
    monkeypatch.setattr(token_counts, "PART", 7)
    text = "some <|endoftext|> words' end été ends"
    lengths = token_counts.Lengths(splitter.tokenizer, {"some": 1})
    assert splitter.count(text, lengths) == len(splitter.tokenizer.encode(text, add_special_tokens=False).ids)


def ranked(docs, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = [(d, Counter(pattern.findall((t or "").translate(_LOW)))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df, out = Counter(t for _, c in own for t in c), []
    for name, text in items:
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(pattern.findall((text or "").translate(_LOW))) if df[t]}
        scores = []
        for d, c in own:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(1, n_terms)
            s = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weight.items() if t in c)
            scores.append((-s, d is not None, d or 0))
        out += [(name, r + 1, d if some else None, -s) for r, (s, some, d) in enumerate(sorted(x for x in scores if x[0])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 7, 500])
def test_ranked_search_against_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(ranked_search, "DOCS", 16)
    monkeypatch.setattr(ranked_search, "RUN", 5)  # an item's terms come in several runs
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 200)  # several blocks of items
    rng = random.Random(k)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "ärger", "été", "x1"]
    docs = [(i, " ".join(rng.choice(words[: rng.randint(1, 64)]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    docs += [(3, docs[3][1])] * 3 + [(None, "w1 w2 W3"), (None, None), (901, None), (902, ""), (903, "-- !"), (904, "w5 " * 9000), (905, "W5-w5_w6　w7")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(20)]
    items += [(0, items[0][1]), (50, None), (51, ""), (52, "unknown"), (53, " ".join(words)), (None, "w5 w6")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, item string, score int").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, number int")
    got = ranked_search.search(ranked_search.build_index(frame), asked, k=k)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, k)


def test_ranked_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    items = spark.createDataFrame([("q", "a")], "item_id string, text string")
    empty, index = ranked_search.build_index(docs.limit(0)), ranked_search.build_index(docs)
    assert ranked_search.search(empty, items).count() == 0
    assert ranked_search.search(index, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ranked_search.search(index, items).collect()] == [("q", 1, 1)]


def test_bounds_are_never_below_the_scores():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 80))).encode() for _ in range(40)]
    ids, n, width, slices, _ = ranked_search._block(list(range(40)), texts, ranked_search._Hashes())
    df = Counter(t for x in texts for t in set(ranked_search.terms(x)))
    asked = ranked_search.Queries([(i, x.encode()) for i, x in enumerate(["a b c", "d", "j i h g"])], df, 40, sum(n))
    top = ranked_search.bounds(asked.runs(), 3, asked.lengths(n), width, slices)
    exact = [[asked.score(x, [i])[0] for x in texts] for i in range(3)]
    assert all(top[i][d] >= exact[i][d] for i in range(3) for d in range(40))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    names = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=str) == sorted(want, key=str)
