"""The operators on small frames with nulls, empty and repeated rows, against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablelens.llm import bpe, decontaminate, embeddings, html_extract, langid, near_dup, pii, repeats, secrets, toxicity

random.seed(9)
SMALL = "/root/testdata/sf0.001"


def docs(spark, rows, schema="doc_id bigint, text string, toxic string, spans string, pii string"):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *["x"] * (width - len(r))) for r in rows], schema)


def linked(sets, percent=80):
    parent = {i: i for i in range(len(sets))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 2)  # most lists go through the block comparison
    words = [f"w{k}" for k in range(40)]
    base = [random.choice(words) for _ in range(60)]
    texts = [None, "", "  ", "one two", "One two", "one two three"]
    for _ in range(30):
        own = list(base)
        for _ in range(random.randint(0, 4)):
            own[random.randrange(60)] = random.choice(words)
        texts.append(" ".join(own))
    texts += [" ".join(random.choice(words) for _ in range(random.randint(1, 30))) for _ in range(20)] + texts[6:9]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs(spark, enumerate(texts)), width=4).collect()}
    want = linked(sets)
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [
        (len(s), r, r == i) for i, (s, r) in enumerate(zip(sets, want))
    ]
    odd = docs(spark, [(None, "a b c d e"), (7, "a b c d e"), (7, None), (None, None)])
    assert sorted((str(r.doc_id), str(r.component_id)) for r in near_dup.near_duplicates(odd).collect()) == [
        ("7", "7"), ("7", "7"), ("None", "7"), ("None", "None"),
    ]
    assert near_dup.keep_one(odd).count() == 3
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_links_small_sets_to_larger_ones(spark):
    # sets of 26 to 32 shingles inside one of up to a quarter more: all within 0.8
    sizes = [(32, 39), (32, 40), (31, 38), (30, 37), (26, 32), (33, 41)]
    rows = []
    for k in range(240):
        small, large = sizes[k % len(sizes)]
        words = [f"p{k}w{j}" for j in range(large + 3)]
        rows += [(2 * k, " ".join(words[: small + 3])), (2 * k + 1, " ".join(words))]
    got = near_dup.near_duplicates(docs(spark, rows), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}


def test_keep_one_without_ids(spark):
    rows = [(None, "one unique text of some words"), (None, "a pair of equal texts"), (None, "a pair of equal texts")]
    rows += [(None, "A pair of equal texts"), (None, ""), (None, ""), (None, None), (7, "another text that has its id"), (7, "Another text that has its id")]
    frame = docs(spark, rows)
    assert sorted((r.text or "").lower() for r in near_dup.keep_one(frame).collect()) == [
        "", "", "", "a pair of equal texts", "another text that has its id", "one unique text of some words",
    ]
    assert near_dup.near_duplicates(frame).where("kept").count() == 6


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((4, 16))
    vectors = [(base[k % 4] + 0.08 * rng.standard_normal(16)).tolist() for k in range(40)]
    rows = [(k, v, k % 2) for k, v in enumerate(vectors)] + [(40, vectors[0], 0), (41, None, 0), (42, [0.0] * 16, 0), (43, [float("nan")] * 16, 0), (44, vectors[0], None), (45, [], 1), (46, [1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("n_links", F.lit("x"))
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    x = np.array([v for _, v, _ in rows[:41]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:41]])
    link = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    found = sum(got[k].n_links for k in range(41))
    assert link.sum() >= found >= 0.9 * link.sum()
    assert all(got[k].n_links == 0 and got[k].kept for k in range(41, 47))
    assert got[40].component_id == got[0].component_id
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_repeats(spark):
    part = "".join(random.choice("abcdef ") for _ in range(260))
    own = lambda n: "".join(random.choice("ghijklmé ") for _ in range(n))
    texts = [None, "", part[:150], own(300) + part + own(50), own(10) + part[20:240], part[30:229] + own(5), own(400), "na" * 300, "x" + part + part]
    texts += [texts[6]] * 2
    got = {r.doc_id: r for r in repeats.digest(repeats.remove_repeats(docs(spark, enumerate(texts)))).collect()}
    raw = [(t or "").encode() for t in texts]
    met = {}
    for b in raw:
        for i in range(len(b) - 199):
            met[b[i : i + 200]] = met.get(b[i : i + 200], 0) + 1
    for k, b in enumerate(raw):
        cover = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 199):
            if met[b[i : i + 200]] > 1:
                cover[i + 1 : i + 201] = True
        kept = bytes(c for c, gone in zip(b, cover[1:-1]) if not gone)
        spans = int((np.diff(cover.astype(int)) == 1).sum())
        assert tuple(got[k])[1:] == (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_pii(spark):
    alphabet = ["1", "2", "0", ".", "@", "a", "b.c", "+", " ", "-", "_", "é😀", "(", "4111111111111111", "10.0.0.255", "x@y.zz"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 30))) for _ in range(300)]
    texts += [None, "", "a@b.c_d@e.f", "00000300.1.1.1", "1." * 5000, "1 " * 9000 + "1", "a" * 200_000, "1.2.3.4.5.6.7.8"]
    got = {r.doc_id: r for r in pii.digest(pii.find(docs(spark, enumerate(texts)).drop("pii").withColumn("pii", F.lit(1)), keep_text=False)).collect()}
    for k, t in enumerate(texts):
        found = sorted(
            (m.start(), n, m.end(), kind) for n, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if valid(kind, m[0])
        )
        want = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in found)
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(f[3] == x for f in found) for x in PATTERNS]


def test_pii_disclosing_terms_and_sanitising(spark):
    rows = [(k, f"the report of zanzibar to joe@corp.com about weather {k}") for k in range(3)]
    rows += [(k, "the weather report about nothing of note") for k in range(3, 60)] + [(60, None), (61, "")]
    out = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}
    assert "joe@" not in out[0] and "<EMAIL>" in out[0] and "zanzibar" not in out[0] and "weather" in out[0]
    assert out[5] == rows[5][1] and out[60] is None and out[61] == ""
    assert pii.find(docs(spark, [])).count() == 0


def test_pii_disclosing_terms_everywhere(spark, monkeypatch):
    far = "nothing of note " * 40
    rows = [(k, f"the report of zanzibar to joe@corp.com about weather {k}. {far}Zanzibar again, xzanzibar not") for k in range(3)]
    # text without white space, cut at the window's edge inside a word
    rows += [(k, f'{{"k":"{"abcd" * 40}","who":"quixote","mail":"sue@corp.com","{"efgh" * 40}"}}') for k in range(3, 6)]
    rows += [(k, "the weather report about nothing of note") for k in range(6, 70)]
    rows += [(70, "no address, but Zanzibar."), (71, None)]
    for limit in (pii.BROADCAST_BYTES, -1):
        monkeypatch.setattr(pii, "BROADCAST_BYTES", limit)
        found = {r.doc_id: r for r in pii.find(docs(spark, rows).drop("pii")).collect()}
        said = {k: [r.text[s.start : s.end].lower() for s in r.pii if s.kind == "term"] for k, r in found.items()}
        assert said[0] == ["zanzibar", "zanzibar"] and said[70] == ["zanzibar"] and said[8] == said[71] == []
        assert "quixote" in said[3] and "abcd" * 40 not in said[3]
    out = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}
    assert "xzanzibar not" in out[0] and "zanzibar" not in out[0].replace("xzanzibar", "").lower() and "zanzibar" not in out[70].lower()


def test_decontaminate_spans_and_blocks(spark, monkeypatch):
    text = "Intro here. The quick brown fox jumps over the lazy dog tonight again. Tail é."
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog tonight"), (2, "tail É"), (3, None), (4, "intro")], "item_id bigint, text string")
    frame = docs(spark, [(0, text), (1, None), (2, ""), (3, "clean")])
    one = [tuple(r) for r in decontaminate.digest(decontaminate.annotate(frame, bench)).orderBy("doc_id").collect()]
    assert [r[1:4] for r in one] == [(15, 11, 2), (0, 0, 0), (0, 0, 0), (1, 0, 0)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    found = decontaminate.annotate(frame, bench)
    assert [tuple(r) for r in decontaminate.digest(found).orderBy("doc_id").collect()] == one
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(found).collect()}
    assert cut[0] == "\n here. \n again. Tail é." and cut[1] is None and cut[3] == "clean"
    assert decontaminate.annotate(frame.limit(0), bench).count() == 0
    assert decontaminate.annotate(frame, bench.limit(0)).where("n_hit > 0").count() == 0


def test_bpe_in_spark(spark):
    frame = docs(spark, [(0, "Hello  world's é"), (1, None), (2, ""), (2, "x" * 10_000)]).withColumn("token_ids", F.lit(1))
    back = bpe.decode(bpe.encode(frame)).orderBy("doc_id", "text").collect()
    assert [bytes(r.decoded).decode() for r in back] == [r.text or "" for r in back]
    assert all((r.token_ends[-1] if r.token_ends else 0) == len((r.text or "").encode()) for r in back)
    assert bpe.digests(bpe.encode(frame.limit(0))).count() == 0


def test_language_id(spark):
    known = spark.read.parquet(f"{SMALL}/documents.parquet")
    profiles = langid.learn(known.where("doc_id % 2 = 0"))
    got = langid.predict(known.where("doc_id % 2 = 1 and n_chars > 200").withColumn("score", F.lit(0)), profiles)
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    odd = langid.predict(docs(spark, [(0, None), (1, ""), (2, "12 !"), (3, "\u0301 \u0308\u0303 7"), (4, "é"), (5, "e\u0301 \u0301"), (5, "e\u0301 \u0301")]), profiles)
    odd = odd.orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:4]] == ["und"] * 4 and all(r.lang_pred in profiles for r in odd[4:])
    assert [r.score for r in odd[:4]] == [0.0] * 4 and odd[5] == odd[6]
    assert langid.learn(known.limit(0)) == {}
    assert {r.lang_pred for r in langid.predict(known.limit(5), {}).collect()} == {"und"}


def test_toxicity(spark):
    rows = [(k, f"plain words number {k % 7} here") for k in range(60)] + [(k, f"you vile creature number {k % 7}") for k in range(60, 90)]
    labels = spark.createDataFrame([(k, int(k >= 60)) for k, _ in rows] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    frame = docs(spark, [*rows, (90, None), (91, ""), (92, "VILE creature")])
    model = toxicity.train(frame, labels)
    got = {r.doc_id: r.toxic for r in toxicity.score(frame, model).collect()}
    assert [got[k] for k in (0, 59, 60, 89, 90, 91, 92)] == [False, False, True, True, False, False, True]
    none = toxicity.train(frame, labels.where("toxic = 0"))
    assert toxicity.score(frame, none).where("toxic").count() == 0
    assert toxicity.score(frame.limit(0), model).count() == 0


def test_html_style_tree(spark):
    page = "<body><div>{}</div><div class='box'><span>Follow us today</span></div></body>"
    rows = [(k, "http://a.example/x" + str(k), page.format(f"story {k}")) for k in range(10)]
    rows += [(10, None, None), (11, "bad", ""), (12, "http://b.example/", page.format("alone")), (12, "http://b.example/", page.format("alone"))]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("x"))
    got = sorted((r.page_id, r.text) for r in html_extract.extract(frame).collect())
    assert got[3] == (3, "story 3") and got[10:12] == [(10, ""), (11, "")]
    assert [t for _, t in got[12:]] == ["alone Follow us today"] * 2
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_html_style_tree_keeps_repeated_articles(spark):
    page = "<html><title>{0}</title><body><nav>menu {0}</nav><div class='top'>top {0}</div><article><p>{1}</p><div class='box'>Follow us</div></article></body></html>"
    rows = [(k, "http://a.example/", page.format(k, "one story of the host")) for k in range(10)]
    rows += [(10, "http://a.example/own", page.format(10, "a story of its own"))]
    # a counter inside the article makes every copy a page of its own
    count = "<main><i>seen {} times</i><p>one story of the host that is read by many</p></main>"
    rows += [(20 + k, "http://b.example/", count.format(k)) for k in range(12)]
    # what a host's articles repeat still goes
    rows += [(40 + k, "http://c.example/", page.format(k, f"story {k} of many that this host has")) for k in range(10)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(frame).collect()}
    assert all(got[k].startswith("one story of the host") for k in range(10)) and got[10].startswith("a story of its own")
    assert all("read by many" in got[20 + k] for k in range(12))
    assert [got[40 + k] for k in range(10)] == [f"story {k} of many that this host has" for k in range(10)]


def test_secrets(spark):
    secret = lambda: "".join(random.choice("0123456789abcdef") for _ in range(40))
    rows = [(k, f'set token = "{secret()}" and internationalisation words') for k in range(40)]
    rows += [(k, "plain internationalisation words of extraordinarycharacteristics") for k in range(40, 80)] + [(80, None), (81, "")]
    found = secrets.scan(docs(spark, rows)).collect()
    assert {r.doc_id for r in found} == set(range(40))
    assert all(rows[r.doc_id][1][r.start : r.end] == r.value for r in found)
    assert secrets.scan(docs(spark, rows[40:])).count() == 0
    assert secrets.scan(docs(spark, [])).count() == 0


def test_secrets_assigned_values(spark):
    hexes = "0123456789abcdef0123"
    cases = [
        ('password = "hunter2Xy9" and', ["hunter2Xy9"]), ("my pwd: 'p@ss!W0rd$ 1'", ["p@ss!W0rd$ 1"]), ("curl ?token=Ab1.c2&x=1", ["Ab1.c2"]),
        (f"run token={hexes}.", [hexes]), (f"run --session={hexes}", [hexes]), ('{"api_key": "k3y!"}', ["k3y!"]), (r'secret="a\"b1"', [r"a\"b1"]),
        (f"x /opt/mytoken={hexes}!é", [f"{hexes}!é"]), (f'auth: "see {hexes} there"', [f"see {hexes} there", hexes]), (f"é😀 {hexes}==", [f"{hexes}=="]),
        ("password:", []), ("no token here", []), ('passwd="' + "a1!" * 40_000 + '"', ["a1!" * 40_000]),
    ]
    found = secrets.candidates(docs(spark, [(k, t) for k, (t, _) in enumerate(cases)])).collect()
    for k, (t, want) in enumerate(cases):
        got = [r for r in found if r.id == k]
        assert sorted(r.value for r in got) == sorted(want), t
        assert all(t[r.start : r.end] == r.value for r in got)
    short = lambda k: "".join(random.sample("abcdefgXYZ", 6)) + f"{k % 10}{(k + 3) % 10}{k % 7}"
    rows = [(k, f'set password = "{short(k)}" and internationalisation words') for k in range(40)]
    rows += [(k, "plain internationalisation words of extraordinarycharacteristics") for k in range(40, 80)]
    assert {r.doc_id for r in secrets.scan(docs(spark, rows)).collect()} == set(range(40))


def test_pii_of_texts_with_very_many_spans(spark):
    # one domain of many labels; many addresses with terms between them, in two texts
    labels = "a@b" + ".c" * 100_000
    many = " ".join(f"10.0.{i % 250}.{i % 200} host{'abc'[i % 3]}wort" for i in range(1500))
    frame = docs(spark, [(0, labels), (1, many), (2, "10.0.3.3 hostawort and 10.0.3.3"), (3, "x")])
    got = {r.doc_id: r for r in pii.digest(pii.find(frame.drop("pii", "spans"))).collect()}
    assert [(got[k].n_email, got[k].n_ip) for k in range(4)] == [(1, 0), (0, 1500), (0, 2), (0, 0)]
    assert got[0].spans == f"email:0:{len(labels)}"
    base = [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", many)]
    assert [x for x in got[1].spans.split(",") if x.startswith("ip")] == base
    out = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert out[0] == "<EMAIL>" and out[1].count("<IP>") == 1500 and out[3] == "x"
    # base spans inside others, and what of the text stays between them
    assert {r.text for r in pii.sanitise(docs(spark, [(0, "é 1.1.1.1.x@y.zz, +1 (234) 567-8901; ñ")])).collect()} == {"é <EMAIL>, <PHONE>; ñ"}


def test_context_terms_do_not_touch_any_base_span(spark):
    text = "prefixword 10.0.0.1 middleword me@mailhost.example tailword " + "x" * 130 + " farword"
    rows = pii._mentions(pii._with_base(spark.createDataFrame([(text,)], "text string"), "text")).collect()
    assert {r.entity: sorted(r.terms) for r in rows} == {
        "ip:10.0.0.1": ["middleword", "prefixword", "tailword"],
        "email:me@mailhost.example": ["middleword", "prefixword", "tailword"],
    }


def pipeline_rows():
    words = [f"w{k}" for k in range(30)]
    rng = random.Random(4)
    base = [rng.choice(words) for _ in range(40)]
    near = [*base[:20], "other", *base[21:]]
    rows = [(0, None), (1, ""), (2, " "), (3, " ".join(base)), (4, " ".join(near)), (5, " ".join(base)), (5, " ".join(base))]
    rows += [(k, " ".join(rng.choice(words) for _ in range(25))) for k in range(6, 20)]
    rows += [(20, "write to me@mail.example or 10.1.2.3 soon"), (21, "before " + " ".join(f"q{k}" for k in range(10)) + " after"), (None, "no id here at all but words")]
    rows += [(22, " ".join(f"q{k}" for k in range(10))), (23, "long " + "z1 z2 " * 20_000)]
    return rows


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rows = pipeline_rows()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(10))), (2, None), (3, "")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    run = lambda name, f: stage[name](spark, f, str(tmp_path))
    key = lambda r: (str(r[0]), str(r[1]))
    # without labels nothing is rejected
    assert sorted(run("toxicity", frame).select("doc_id", "text").collect(), key=key) == sorted(rows, key=key)
    # near duplicates: sets of five words, the smallest id of each group, repeated rows once
    distinct = list(dict.fromkeys(rows))
    sets = []
    for _, t in distinct:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    want = [distinct[i] for i, r in enumerate(linked(sets)) if r == i]
    got = run("near_duplicates", frame)
    assert sorted((tuple(r) for r in got.select("doc_id", "text").distinct().collect()), key=key) == sorted(want, key=key)
    # benchmark windows are cut, emptied documents go
    cut = {r.doc_id: r.text for r in run("decontamination", frame).collect()}
    assert 22 not in cut and cut[21].split() == ["before", "after"] and cut[20] == rows[-5][1] and cut[0] is None
    assert len(cut) == len({i for i, _ in rows}) - 1
    # personal data
    clean = {r.doc_id: r for r in run("pii", frame).collect()}
    assert clean[20].text == "write to <EMAIL> or <IP> soon" and clean[20].n_chars == len(clean[20].text)
    assert clean[3].text == rows[3][1] and clean[0].text is None
    # tokens decode to the texts
    tokens = run("byte_bpe", frame).withColumn("text", F.lit(None).cast("string"))
    back = sorted((bytes(r.decoded).decode() for r in bpe.decode(tokens).collect()))
    assert back == sorted(t or "" for _, t in rows)
    for name in stage:
        assert run(name, frame.limit(0)).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SMALL).collect()
    source = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert 0 < len(out) <= len(source) and len({r.doc_id for r in out}) == len(out)
    assert set(out[0].asDict()) == {"doc_id", "lang", "source", "token_ids", "token_ends"}


@pytest.fixture(autouse=True)
def shared(spark, tmp_path):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path}")
