"""Personal data, found by patterns and by what corpus co-occurrence discloses.

Base spans are matches of four patterns (email, ip, card, phone). They are the protected
entities. A term (word of 4 or more letters) within `CONTEXT` characters of an entity may
disclose it. Over the whole corpus, with N documents, the information that term t gives on
entity e is PMI(t, e) = log2(N * c(t, e) / (c(t) * c(e))), where c(t) counts documents with
the term, c(e) with the entity, c(t, e) with the term in the entity's context; the entity's
own information is IC(e) = log2(N / c(e)). A term whose PMI reaches `GENERALISE` of IC is
generalised wherever it stands in the corpus, one that reaches `REMOVE` is removed (the
largest share over all entities counts); pairs seen in fewer than `SUPPORT` documents prove
nothing. Terms that touch a base span are part of it. Only DataFrame functions run.

Defined results: a null text counts as empty and has no spans (`sanitise` leaves it null);
equal texts have equal spans; rows with equal ids are judged one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .native import earlier_max, let, matches, part, pieces, prefix_sums

#: Share of an entity's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Documents that must show a term in an entity's context.
SUPPORT = 2
#: Characters on either side of an entity that are its context.
CONTEXT = 120
#: Disclosing terms, and texts with such terms, up to this size are sent to all tasks.
BROADCAST_BYTES = 8 << 20

# The patterns (possessive where that changes no match, so that they are
# linear on any text).
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"\p{L}{4,}+"
KINDS = ("email", "ip", "card", "phone")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, value>>, by start and then kind."""
    digit = text.rlike("[0-9]")
    email = matches(text, EMAIL, "email", 0, F.contains(text, F.lit("@")))
    ip = F.filter(matches(text, IP, "ip", 1, digit), lambda m: m["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    card = F.filter(
        matches(text, CARD, "card", 2, digit),
        lambda m: F.char_length(m["value"]).between(12, 37)
        & F.char_length(_digits(m["value"])).between(12, 19)
        & F.call_function("luhn_check", _digits(m["value"])),
    )
    phone = F.filter(
        matches(text, PHONE, "phone", 3, F.contains(text, F.lit("+"))), lambda m: F.char_length(_digits(m["value"])).between(9, 15)
    )
    return F.array_sort(F.concat(email, ip, card, phone))


#: Stretches of base spans that can lie within CONTEXT on either side (the shortest has 5 characters).
_NEAR = CONTEXT // 5 + 1


def _covered(base: Column) -> Column:
    """struct<spans, at> of a non-empty array of base spans: the disjoint stretches that they
    cover, in order, and the number (from 1) of the stretch of every span."""

    def stretches(marks: Column) -> Column:
        last = F.array_max(F.transform(base, lambda b: b["end"]))
        return let(
            F.filter(marks, lambda m: m["first"]),
            lambda firsts: F.transform(
                firsts, lambda f, k: F.struct(f["start"].alias("start"), F.coalesce(F.get(firsts, k + 1)["past"], last).alias("end"))
            ),
        )

    def marked(past: Column) -> Column:
        return F.transform(
            base,
            lambda b, i: F.struct(
                b["start"].alias("start"), F.get(past, i).alias("past"), ((i == 0) | (b["start"] > F.get(past, i))).alias("first")
            ),
        )

    ends = F.transform(base, lambda b: b["end"])
    marks = let(ends, lambda e: let(earlier_max(e), marked))
    return let(
        marks,
        lambda m: F.struct(
            stretches(m).alias("spans"),
            let(F.transform(m, lambda x: x["first"].cast("int")), prefix_sums).alias("at"),
        ),
    )


def _terms(window: Column, offset: Column, near: Column) -> Column:
    """Terms of a context window that do not touch a covered stretch, with text positions."""
    found = F.transform(
        matches(window, TERM, "term", 4),
        lambda m: F.struct((m["start"] + offset).alias("start"), (m["end"] + offset).alias("end"), F.lower(m["value"]).alias("term")),
    )
    return F.filter(found, lambda t: ~F.exists(near, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))


def _keys(text: Column) -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(text, F.lit(1)).alias("__k1"), F.xxhash64(F.lit(2), text).alias("__k2")]


def _with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds the base spans, the terms in their contexts, and two hashes that stand for the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def context(m: Column, i: Column, length: Column) -> Column:
        begin = F.greatest(m["start"] - CONTEXT, F.lit(0))
        # one character more shows whether the window's edge cuts a word, which does not count
        more = F.greatest(begin - 1, F.lit(0))
        left = part(F.col("__pieces"), more, m["start"] - more)
        left = F.when(begin > 0, F.regexp_replace(left, r"(?s)^(?:\p{L}++|.)", "")).otherwise(left)
        right = part(F.col("__pieces"), m["end"], F.lit(CONTEXT + 1))
        right = F.when(m["end"] + CONTEXT < length, F.regexp_replace(right, r"(?s)(?:\p{L}++|.)\z", "")).otherwise(right)
        # only the stretches around the mention are compared with its terms
        near = F.slice(F.col("__covered.spans"), F.greatest(F.get(F.col("__covered.at"), i) - _NEAR, F.lit(1)), F.lit(2 * _NEAR + 1))
        terms = let(
            near,
            lambda spans: F.concat(
                let(left, lambda window: _terms(window, m["start"] - F.char_length(window), spans)),
                let(right, lambda window: _terms(window, m["end"], spans)),
            ),
        )
        return F.struct(
            F.concat_ws(":", m["kind"], m["value"]).alias("entity"), F.array_distinct(F.transform(terms, lambda t: t["term"])).alias("terms")
        )

    some = F.size("__base") > 0
    return (
        docs.withColumn("__base", base_spans(text))
        .withColumn("__covered", F.when(some, _covered(F.col("__base"))))
        .withColumn("__pieces", F.when(some, pieces(text)))
        .withColumn(
            "__contexts",
            F.when(some, let(F.char_length(text), lambda length: F.transform("__base", lambda m, i: context(m, i, length)))),
        )
        .drop("__covered", "__pieces")
        .select("*", *_keys(text))
    )


def _mentions(rows: DataFrame) -> DataFrame:
    """One row per base span: row number, text hashes, entity, and the context's terms."""
    # numbered before the rows are multiplied: counts are of documents
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    return rows.select("__k1", "__k2", "__row", F.explode("__contexts").alias("m")).select("__k1", "__k2", "__row", "m.entity", "m.terms")


def disclosing_terms(docs: DataFrame, mentions: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, share): pairs whose term gives at least GENERALISE of the entity's
    information. Counts are documents, over the whole corpus."""
    total = docs.count()
    pairs = (
        mentions.select("__row", "entity", F.explode("terms").alias("term"))
        .distinct()
        .groupBy("entity", "term")
        .agg(F.count("*").alias("c"))
        .where(F.col("c") >= SUPPORT)
    )
    entities = mentions.select("__row", "entity").distinct().groupBy("entity").agg(F.count("*").alias("ce"))
    terms = docs.select(F.explode(_words(F.col(text_col).cast("string"))).alias("term")).groupBy("term").agg(F.count("*").alias("ct")).where(F.col("ct") >= SUPPORT)
    n = F.lit(float(max(total, 1)))
    pmi = F.log2(n * F.col("c") / (F.col("ct") * F.col("ce")))
    ic = F.log2(n / F.col("ce"))
    return (
        pairs.join(entities, "entity")
        .join(terms, "term")
        .withColumn("share", F.when(ic > 0, pmi / ic).otherwise(0.0))
        .where(F.col("share") >= GENERALISE)
        .select("entity", "term", "share")
    )


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def _sent(df: DataFrame, size: Column) -> DataFrame:
    """The frame, marked for broadcast if its rows of `size` bytes each are few."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def _disclosed(docs: DataFrame, text_col: str) -> DataFrame:
    """(__k1, __k2, __terms, __shares): for every text with disclosing terms, these, wherever
    they stand and whether or not the text has an entity."""
    rows = cut(_with_base(docs.select(text_col), text_col).drop(text_col))
    mentions = cut(_mentions(rows.where(F.size("__base") > 0)))
    terms = cut(disclosing_terms(docs, mentions, text_col).groupBy("term").agg(F.max("share").alias("share")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(*_keys(text), F.explode(_words(text)).alias("term"))
    # copies of a text give equal rows, which the set takes once before they are dealt out
    hits = (
        words.join(_sent(terms, F.octet_length("term") + 64), "term")
        .groupBy("__k1", "__k2")
        .agg(F.sort_array(F.collect_set(F.struct("term", "share"))).alias("hits"))
    )
    return cut(hits.select("__k1", "__k2", F.col("hits.term").alias("__terms"), F.col("hits.share").alias("__shares")))


def find(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds `pii`: array<struct<start, rank, end, kind, value, share>> by start and kind; base
    spans have the kinds of KINDS, disclosing terms the kind `term`. A clashing column is
    overwritten. Without `keep_text` the text column goes."""
    docs = docs.drop("pii")
    hits = _disclosed(docs, text_col)
    hits = _sent(hits, F.octet_length(F.array_join("__terms", ",")) + 16 * F.size("__terms") + 64)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the spans are found below the join, so that they are computed once
    rows = docs.select("*", base_spans(text).alias("__base"), *_keys(text)).join(hits, ["__k1", "__k2"], "left")
    base = F.transform("__base", lambda b: F.struct(b["start"], b["rank"], b["end"], b["kind"], b["value"], F.lit(1.0).alias("share")))
    found = F.filter(
        matches(text, TERM, "term", 4, F.col("__terms").isNotNull()),
        lambda t: F.array_contains(F.col("__terms"), F.lower(t["value"])),
    )
    terms = F.transform(
        found,
        lambda t: F.struct(
            t["start"],
            t["rank"],
            t["end"],
            t["kind"],
            F.lit("").alias("value"),
            F.get("__shares", (F.array_position(F.col("__terms"), F.lower(t["value"])) - 1).cast("int")).alias("share"),
        ),
    )
    kind = "array<struct<start:int,rank:int,end:int,kind:string,value:string,share:double>>"
    own = base.cast(kind)
    spans = F.when(F.size("__found") == 0, own).otherwise(_untouched(F.array_sort(F.concat(own, F.col("__found")))))
    names = [c for c in docs.columns if keep_text or c != text_col]
    return rows.withColumn("__found", terms.cast(kind)).select(*names, spans.alias("pii"))


def _untouched(spans: Column) -> Column:
    """Sorted spans without the terms that touch a base span. A base span that touches a
    term starts before it and ends inside (the largest earlier end tells), or starts inside
    it and is then the next span."""

    def keep(sorted_: Column, past: Column) -> Column:
        return F.filter(
            sorted_,
            lambda s, i: (s["kind"] != "term")
            | (
                (F.get(past, i) <= s["start"])
                & ~F.coalesce((F.get(sorted_, i + 1)["kind"] != "term") & (F.get(sorted_, i + 1)["start"] < s["end"]), F.lit(False))
            ),
        )

    return let(
        spans,
        lambda both: let(
            F.transform(both, lambda s: F.when(s["kind"] != "term", s["end"]).otherwise(0)),
            lambda ends: let(earlier_max(ends), lambda past: keep(both, past)),
        ),
    )


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    kinds = F.col("pii.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("pii", lambda s: s["kind"] != "term")
    return found.select(id_col, *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced: base spans by their kind (`<EMAIL>`),
    generalised terms by `<TERM>`, removed terms by nothing. Of overlapping spans the
    parts are replaced once, under the first span's name."""
    found = find(docs, text_col).withColumn("__pieces", F.when(F.size("pii") > 0, pieces(F.col(text_col))))
    text = F.col(text_col)

    def name(s: Column) -> Column:
        kind = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["kind"] != "term", kind).when(s["share"] >= REMOVE, F.lit("")).otherwise(F.lit("<TERM>"))

    def replaced(past: Column) -> Column:
        # the text since the furthest earlier end, then the span's name; nothing for a span inside
        return F.transform(
            "pii",
            lambda s, i: F.when(
                (i == 0) | (s["start"] >= F.get(past, i)),
                F.concat(part(F.col("__pieces"), F.get(past, i), s["start"] - F.get(past, i)), name(s)),
            ).otherwise(F.lit("")),
        )

    ends = F.transform("pii", lambda s: s["end"])
    parts = let(ends, lambda e: let(earlier_max(e), replaced))
    last = F.array_max(ends)
    whole = F.concat(F.array_join(parts, ""), part(F.col("__pieces"), last, F.char_length(text) - last))
    return found.withColumn(text_col, F.when(F.size("pii") > 0, whole).otherwise(text)).drop("pii", "__pieces")
