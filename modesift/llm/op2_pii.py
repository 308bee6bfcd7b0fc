"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that reveal them
(DataFrame functions only).

Base spans are the leftmost non-overlapping matches of four patterns, checked after matching (address
parts, Luhn, digit counts). Protected are each kind and each single entity (a kind's value). The corpus
tells how strongly a term (a word of three letters or more, lower-cased) reveals one of them: the disclosure of c by
term t is the share of c's information that t gives away,

    D(c; t) = log(p(c|t) / p(c)) / -log p(c),

1 where t occurs only beside c, 0 where they are independent. Evidence for t beside a kind is the number
of different entities of the kind it occurs with; beside an entity, the number of different texts that
hold both, where copies and near copies (texts with an entity in common whose words and entities agree
by half, found through min-hashes, and what these join) are one text. Evidence against is every document
with t and without c. p(c|t) is shrunk towards p(c) by ``prior`` pseudo-documents. Chance meetings
disclose nothing: evidence counts only if the odds of as much by chance (Chernoff's bound), taken over
as many pairs as documents squared, are below ``chance``; so three texts at least are needed, and few
more where t occurs nowhere else. In documents that hold c, terms with disclosure from ``generalise`` on
are generalised and from ``remove`` on removed. Rewriting puts [KIND] for base spans and [TERM] for
generalised terms.

Terms are counted over all documents in one grouped sum with partial aggregation; the terms found are
joined only to documents that hold personal data.

Defined results: null text is empty text without spans (``sanitise`` leaves it null); null ids are
kept; repeated rows each get their row; an empty table gives no rows; extra columns pass through
``sanitise``, except that names beginning with ``pii__`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, documents, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Written without backtracking, so long runs cost linear time: an e-mail begins where its run of local
#: characters does or right after the match before; repetitions that nothing follows are possessive.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A run of fewer than 14 digits fails wherever the match begins in it, so asking for 14 here only drops failing matches early.
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: A term has three letters at least and stands alone: letters within hexadecimal keys and the like are no words.
_EDGE = r"[\p{L}\p{N}_]"
TERM = rf"(?<!{_EDGE})\p{{L}}{{3,}}+(?!{_EDGE})"
#: Min-hashes of a text: pairs that agree by half share one of so many bands of two with odds of 0.97 or more.
BANDS, ALIKE = 12, 0.5


def _luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int>>"


def matches(text: Column, pattern: str | Column, label: Column) -> Column:
    """Spans of all matches: struct(kind, start, end, text). Positions are sums of the lengths of the
    pieces between the matches and of the matches, both cut by the same matcher."""
    found = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>").alias("spans"))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["gap"])
        b = a + F.length(p["hit"])
        return F.struct(b.alias("at"), F.concat(acc["spans"], F.array(F.struct(label.alias("kind"), a.alias("start"), b.alias("end"), p["hit"].alias("text")))).alias("spans"))

    return F.aggregate(pairs, start, step)["spans"]


def _spans_of(text: Column, kind: str) -> Column:
    """Valid spans of a kind; texts without its sign never reach the matcher."""
    sign = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(PATTERNS["card"]), "phone": F.contains(text, F.lit("+"))}[kind]
    all_spans = matches(text, PATTERNS[kind], F.lit(kind))
    good = F.filter(all_spans, lambda s: _valid(kind, s["text"]))
    return F.when(sign, F.transform(good, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).otherwise(F.array().cast(_SPAN))


def base_spans(df: DataFrame, text_col: str) -> DataFrame:
    """df with pii__<kind>: each kind's valid spans."""
    return df.withColumns({f"pii__{k}": _spans_of(text_or_empty(text_col), k) for k in KINDS})


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed (other kinds last), comma-joined."""
    rank = lambda s: F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit(0))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.when(rank(s) == 0, F.lit(99)).otherwise(rank(s)).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def rewrite(text: Column, spans: Column, put) -> Column:
    """The text with each span replaced by put(kind); of overlapping spans the one that begins first,
    then the longest, is replaced and the rest of the others goes with it."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], acc["at"])
        piece = F.concat(F.substring(text, acc["at"] + 1, begin - acc["at"]), F.when(s["start"] >= acc["at"], put(s["kind"])).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], -s["neg_end"]).alias("at"), F.concat(acc["parts"], F.array(piece)).alias("parts"))

    end = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, start, step, end)).otherwise(text)


def _terms(text_col: str) -> Column:
    """The distinct terms of a text outside its base spans: an entity's own parts are no evidence of it."""
    base = F.concat(*(F.col(f"pii__{k}") for k in KINDS))
    return F.array_distinct(F.regexp_extract_all(F.lower(rewrite(text_or_empty(text_col), base, lambda k: F.lit(" "))), F.lit(TERM), F.lit(0)))


def _has(kind: str | None = None) -> Column:
    return F.expr(" or ".join(f"size(pii__{k}) > 0" for k in ([kind] if kind else KINDS)))


def _entities() -> Column:
    """The distinct entities of a document as <kind>:<hash of its text>; ``pii__text`` holds the text."""
    spans = F.concat(*(F.col(f"pii__{k}") for k in KINDS))
    return F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], F.hex(F.xxhash64(F.substring(F.col("pii__text"), s["start"] + 1, s["end"] - s["start"]))))))


def text_classes(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, class) of texts(key, entities, words) that stand for themselves no more: near copies that share an
    entity take the least key of all they are joined to."""
    band = lambda b: F.xxhash64(b, *(F.array_min(F.transform("words", lambda w: F.xxhash64(w, b * 2 + i))) for i in range(2)))
    signed = scratch.write(texts.withColumn("bands", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)))
    dealt = signed.select("key", F.explode("entities").alias("entity"), "bands").select("key", "entity", F.explode("bands").alias("band"))
    # The least of a bucket stands for it, so a bucket's links grow with its texts and not with their pairs.
    least = dealt.groupBy("entity", "band").agg(F.min("key").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = dealt.join(least, ["entity", "band"]).where("key <> leader").select("key", "leader").distinct()
    words = signed.select("key", "words")
    both = links.join(words, "key").join(words.select(F.col("key").alias("leader"), F.col("words").alias("others")), "leader")
    alike = both.where(F.size(F.array_intersect("words", "others")) >= ALIKE * F.size(F.array_union("words", "others")))
    comps = components(texts.sparkSession, alike.select(F.col("key").alias("a"), F.col("leader").alias("b")), scratch)
    return comps.select(F.col("node").alias("key"), F.col("comp").alias("class"))


def disclosing(light: DataFrame, held: DataFrame, text_col: str, generalise: float, chance: float, prior: float) -> DataFrame:
    """(term, target, disclosure) from the threshold on, where a target is a kind or an entity. light: all
    documents with their spans; held: a kept copy of those that have any."""
    scratch = Scratch(light.sparkSession)
    text = text_or_empty(text_col)
    of_held = scratch.write(held.withColumn("pii__text", text).select(F.xxhash64("pii__text").alias("key"), _entities().alias("entities"), _terms(text_col).alias("terms")))
    # Only entities of two different texts or more can have evidence; few texts hold one.
    often = of_held.select(F.explode("entities").alias("target"), "key").distinct().groupBy("target").agg(F.count("*").alias("texts")).where("texts > 1").select("target")
    beside = scratch.write(of_held.select("key", F.explode("entities").alias("target"), "terms").join(often, "target", "left_semi"))
    words = F.array_distinct(F.concat(F.transform(F.concat("terms", "entities"), lambda w: F.xxhash64(w))))
    texts = of_held.join(beside.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("key", "entities", words.alias("words"))
    alike = text_classes(texts, scratch)
    by_entity = beside.join(alike, "key", "left").select("target", F.coalesce("class", "key").alias("evidence"), "terms")
    # For a kind, a document's entities of it stand for it by the least of them, the same in all its copies.
    own = F.transform(F.array(*map(F.lit, KINDS)), lambda k: F.struct(k.alias("target"), F.array_min(F.filter("entities", lambda e: F.startswith(e, F.concat(k, F.lit(":"))))).alias("entity")))
    by_kind = of_held.select(F.explode(F.filter(own, lambda o: o["entity"].isNotNull())).alias("o"), "terms").select("o.target", F.xxhash64("o.entity").alias("evidence"), "terms")
    # The empty term stands for every document.
    met = by_kind.unionByName(by_entity).select("target", "evidence", F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
    met = met.groupBy("term", "target", "evidence").agg(F.count("*").alias("docs")).groupBy("term", "target").agg(F.count("*").alias("found"), F.sum("docs").alias("docs"))
    met = scratch.write(met.where("found > 1"))
    # All terms are counted before the join: what is shuffled is a row for each term and task, not each document's.
    every = light.select(F.explode(F.concat(F.array(F.lit("")), _terms(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("all"))
    counted = scratch.write(met.join(every, "term").select("term", "target", "found", (F.col("all") - F.col("docs")).alias("without")))
    whole = counted.where("term = ''").select("target", (F.col("found") + F.col("without")).alias("n"), (F.col("found") / (F.col("found") + F.col("without"))).alias("p"))
    given = (F.col("found") + F.lit(prior) * F.col("p")) / (F.col("found") + F.col("without") + F.lit(prior))
    share = F.col("found") / (F.col("found") + F.col("without"))
    against = F.when(F.col("without") > 0, F.col("without") * F.log((1 - share) / (1 - F.col("p")))).otherwise(0.0)
    odds = F.col("found") * F.log(share / F.col("p")) + against
    sure = (share > F.col("p")) & (odds >= 2 * F.log("n") - F.log(F.lit(chance)))
    scored = counted.where("term <> ''").join(whole, "target").where("p < 1").where(sure).withColumn("disclosure", F.log(given / F.col("p")) / -F.log("p"))
    return scored.where(F.col("disclosure") >= generalise).select("term", "target", "disclosure")


def find(df: DataFrame, text_col: str = "text", generalise: float = 0.5, remove: float = 0.9, chance: float = 0.01, prior: float = 10.0) -> DataFrame:
    """df with pii__<kind> base spans and pii__terms: spans of kind ``term`` (generalised) and
    ``removed``, none overlapping a base span."""
    scratch = Scratch(df.sparkSession)
    light = base_spans(df, text_col)
    held = scratch.write(light.where(_has()))
    terms = scratch.write(disclosing(light, held, text_col, generalise, chance, prior))
    held = held.withColumn("pii__key", F.sha2(text_or_empty(text_col), 256))
    kinds = F.array(*(F.when(_has(k), F.lit(k)) for k in KINDS))
    targets = held.withColumn("pii__text", text_or_empty(text_col)).select("pii__key", F.concat(F.array_compact(kinds), _entities()).alias("targets"), _terms(text_col).alias("own"))
    # Joined by the target, of which a document has few, then by the term.
    told = targets.dropDuplicates(["pii__key"]).select("pii__key", "own", F.explode("targets").alias("target")).join(terms, "target").where(F.array_contains("own", F.col("term")))
    told = told.groupBy("pii__key", "term").agg((F.max("disclosure") >= remove).alias("gone"))
    told = told.groupBy("pii__key").agg(F.collect_list("term").alias("pii__found"), F.collect_list(F.when(F.col("gone"), F.col("term"))).alias("pii__gone"))
    held = held.join(told, "pii__key", "left").drop("pii__key")
    # Terms are runs of letters, so they stand in a pattern as they are.
    pattern = F.concat(F.lit(rf"(?iu)(?<!{_EDGE})(?:"), F.array_join("pii__found", "|"), F.lit(rf")(?!{_EDGE})"))
    base = F.concat(*(F.col(f"pii__{k}") for k in KINDS))
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    spans = F.filter(matches(text_or_empty(text_col), pattern, F.lit("term")), free)
    spans = F.transform(spans, lambda s: F.struct(F.when(F.array_contains("pii__gone", F.lower(s["text"])), F.lit("removed")).otherwise(F.lit("term")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast(_SPAN)
    held = held.withColumn("pii__terms", F.when(F.col("pii__found").isNotNull(), spans).otherwise(none)).drop("pii__found", "pii__gone")
    rest = light.where(~_has()).withColumns({f"pii__{k}": none for k in (*KINDS, "terms")})
    return rest.unionByName(held)


def sanitise(df: DataFrame, text_col: str = "text", **thresholds: float) -> DataFrame:
    """df with the text rewritten: base spans as [KIND], generalised terms as [TERM], removed terms gone."""
    cols = df.columns
    found = find(df, text_col, **thresholds)
    spans = F.concat(*(F.col(f"pii__{k}") for k in KINDS), F.col("pii__terms"))
    put = lambda kind: F.when(kind == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))
    clean = rewrite(F.col(text_col), spans, put)
    return found.withColumn(text_col, clean).select(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.concat(*(F.col(f"pii__{k}") for k in KINDS))
    return found.select("doc_id", *(F.size(F.col(f"pii__{k}")).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, F.col("pii__terms"))).alias("spans"), F.size("pii__terms").cast("long").alias("n_terms"))
