"""Personal data by patterns, and terms that give it away by how they occur with it in the corpus.

Base kinds are found by pattern. Each value found is a protected entity e. A term t is a word of letters outside of the base
values. N, n(e), n(t) and n(e,t) all count documents of the corpus (rows) by the words and values of their whole texts. t discloses
e if PMI(e, t) / IC(e) = log2(N n(e,t) / (n(e) n(t))) / log2(N / n(e)) is at least DISCLOSURE: at 1, t occurs only with e. A term
counts only if it occurs with e in SUPPORT different texts, so copies of one text prove nothing. Candidates are all words but
lower-case words of two letters and single letters of scripts with case, where no name is written so. Disclosing terms are spans of
kind term in every document that holds their entity; sanitising removes base values, leaving their kind, and generalises terms.
Only DataFrame functions are used.

Defined cases: a null text is empty; an empty text has no spans; repeated rows get equal rows, and count each for the corpus; a
null doc_id is carried along; ties need no order, since a term is one span. Other columns are kept by sanitize() and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import discard, materialize

KINDS = ("email", "ip", "card", "phone", "term")
#: Patterns without backtracking over long runs: a match may begin where no character of its first run stands before, or where
#: the match before it ended, which are the places where leftmost matches begin.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched for a kind at all.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: Words that can be names: three letters, two with a capital, or any number in scripts without case.
NAME = r"(?<!\p{L})(?:\p{L}{3,}|\p{Lu}\p{L}|\p{Lo}{1,2})(?!\p{L})"
SUPPORT, DISCLOSURE = 3, 0.95
TERM = len(PATTERNS)
#: Items of a scan, and characters of a long text, that are taken together.
CHUNK, PART = 128, 1024
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind in ("email", "term"):
        return F.lit(True)
    if kind == "ip":
        small = lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.right(F.ltrim(part, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\.", -1), small)
    if kind == "phone":
        return n.between(10, 15)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, doubled(d)).otherwise(d)

    luhn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0
    return F.when(n.between(14, 19), luhn).otherwise(False)


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _running(items: Column, zero: Column, step) -> Column:
    """The states before each item of a scan, in time linear in the items: states of chunks first, then those within each."""

    def of_chunks(chunks: Column) -> Column:
        grown = lambda state, item: F.struct(step(state["now"], item).alias("now"), F.concat(state["all"], F.array(state["now"])).alias("all"))
        empty = F.struct(zero.alias("now"), F.array().cast("array<int>").alias("all"))
        whole = lambda state, chunk: F.struct(F.aggregate(chunk, state["now"], step).alias("now"), F.concat(state["all"], F.array(state["now"])).alias("all"))
        heads = F.aggregate(chunks, empty, whole, lambda state: state["all"])
        inside = lambda chunk, head: F.aggregate(chunk, F.struct(head.alias("now"), F.array().cast("array<int>").alias("all")), grown, lambda state: state["all"])
        return F.flatten(F.zip_with(chunks, heads, inside))

    last = lambda xs: F.greatest(F.floor((F.size(xs) - 1) / CHUNK), F.lit(0)).cast("int")
    return _let(items, lambda xs: _let(F.transform(F.sequence(F.lit(0), last(xs)), lambda k: F.slice(xs, k * CHUNK + 1, CHUNK)), of_chunks))


def _place(kind: str, number: int, pieces: Column, hits: Column) -> Column:
    """Spans from the texts between matches and the matches: lengths add up to places."""
    sizes = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda piece, hit: F.struct(F.length(piece).alias("gap"), F.length(hit).alias("own"), hit.alias("value")))

    def placed(xs: Column) -> Column:
        before = _running(xs, F.lit(0), lambda at, x: at + x["gap"] + x["own"])
        span = lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(number).alias("kind"), (at + x["gap"] + x["own"]).alias("end"), x["value"].alias("value"))
        return F.zip_with(xs, before, span)

    return F.filter(_let(sizes, placed), lambda s: _valid(kind, s["value"]))


def _spans(text: Column, kind: str, number: int, pattern: Column, hint: Column) -> Column:
    """The spans of one pattern; texts without the hint are not searched."""
    both = F.array(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)))
    found = _let(both, lambda x: F.when(F.size(x[1]) > 0, _place(kind, number, x[0], x[1])))
    return F.coalesce(F.when(hint, found), F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start and kind."""
    return F.array_sort(F.concat(*[_spans(text, kind, number, F.lit(pattern), text.rlike(HINTS[kind])) for number, (kind, pattern) in enumerate(PATTERNS.items())]))


def _text() -> Column:
    return F.coalesce(F.col("row.text"), F.lit(""))


def with_base_spans(docs: DataFrame) -> DataFrame:
    """row (all columns as one) and base (spans), stored: the corpus is searched once."""
    return materialize(docs.select(F.struct(*docs.columns).alias("row"), base_spans(F.coalesce("text", F.lit(""))).alias("base")))


def _words(text: Column, pattern: str = r"\p{L}+") -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def _rest() -> Column:
    """The text without base values, as far as words go: no other kind than email has letters."""
    return F.when(F.size("base") > 0, F.regexp_replace(_text(), PATTERNS["email"], " ")).otherwise(_text())


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """(entity, term) pairs at or above the disclosure threshold, from all documents."""
    return _disclosing(with_base_spans(docs.select("doc_id", "text")))


def _disclosing(based: DataFrame) -> DataFrame:
    values = F.array_distinct(F.transform("base", lambda s: s["value"]))
    found = materialize(based.where(F.size("base") > 0).select(F.xxhash64(_text()).alias("key"), values.alias("values"), _rest().alias("rest")))
    # Rows with one text count together.
    held = found.select("key", F.explode("values").alias("entity")).groupBy("entity", "key").agg(F.count("*").alias("n"))
    entities = materialize(held.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("ways")).where(F.col("ways") >= SUPPORT).drop("ways"))
    if entities.isEmpty():
        return entities.select("entity", F.col("entity").alias("term"))
    total = based.count()
    most = lambda n_et, n_e: n_et * F.pow(F.lit(float(total)) / n_e, F.lit(1 - DISCLOSURE)) * (1 + 1e-9)
    # By the documents with personal data alone, common words already occur too often to disclose anything: n(t) is as large at
    # least, and the threshold bounds it from above, for any entity by the one for which it is largest.
    top = entities.agg(F.max(most(F.col("n_e"), F.col("n_e")))).first()[0]
    among = found.select(F.explode(_words(F.col("rest"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_least"))
    among = materialize(among.where((F.col("n_least") >= SUPPORT) & (F.col("n_least") <= top)))
    # Words that can still disclose something, by text; then by entity and term, summed before they are dealt out.
    texts = found.groupBy("key").agg(F.min("rest").alias("rest"))
    names = texts.select("key", F.explode(_words(F.col("rest"), NAME)).alias("term")).join(among, "term")
    lists = materialize(names.groupBy("key").agg(F.collect_list(F.struct("term", "n_least")).alias("names")))
    pairs = held.join(entities, "entity").join(lists, "key").select("entity", "n", "n_e", F.explode("names").alias("t")).where(F.col("t.n_least") <= most(F.col("n_e"), F.col("n_e")))
    pairs = pairs.groupBy("entity", F.col("t.term").alias("term"), F.col("t.n_least").alias("n_least"), "n_e").agg(F.sum("n").alias("n_et"), F.count("*").alias("ways")).where(F.col("ways") >= SUPPORT)
    pairs = materialize(pairs.where(F.col("n_least") <= most(F.col("n_et"), F.col("n_e"))).drop("ways", "n_least"))
    discard(among, lists)
    if pairs.isEmpty():
        return pairs.select("entity", "term")
    # Candidate terms are a stored table: it is broadcast only if its size is below Spark's threshold.
    wanted = materialize(pairs.select("term").distinct())
    seen = based.select(F.explode(_words(_rest())).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    joined = pairs.join(seen, "term")
    share = lambda x: F.log2(F.lit(float(total)) / x)
    pmi = F.log2(F.col("n_et") * float(total) / (F.col("n_e") * F.col("n_t")))
    terms = materialize(joined.where((F.col("n_e") < total) & (pmi >= DISCLOSURE * share(F.col("n_e")))).select("entity", "term"))
    discard(found, wanted, pairs)
    return terms


def with_spans(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """row (all columns), base and spans: base spans and, clear of them, spans of disclosing terms."""
    based = with_base_spans(docs)
    terms = _disclosing(based) if terms is None else terms
    if terms.isEmpty():
        return based.withColumn("spans", F.col("base"))
    # Terms by entity; a document's entities are looked up together, one row for each document that has any.
    lists = materialize(terms.groupBy("entity").agg(F.collect_set("term").alias("terms")))
    key = F.xxhash64(_text())
    holders = based.where(F.size("base") > 0).select(key.alias("key"), _text().alias("same"), F.explode(F.array_distinct(F.transform("base", lambda s: s["value"]))).alias("entity"))
    held = holders.join(lists, "entity").groupBy("key", "same").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"))
    # Only documents with base values meet the terms; the others pass without a shuffle.
    without = based.where(F.size("base") == 0).withColumn("terms", F.lit(None).cast("array<string>"))
    having = based.where(F.size("base") > 0).withColumn("own", key)
    met = having.join(held, (F.col("own") == F.col("key")) & (_text() == F.col("same")), "left").select("row", "base", "terms")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    found = _spans(_text(), "term", TERM, pattern, F.col("terms").isNotNull())
    return without.unionByName(met).withColumn("spans", F.when(F.col("terms").isNull(), F.col("base")).otherwise(_clear(F.array_sort(F.concat("base", found))))).drop("terms")


def _clear(spans: Column) -> Column:
    """Without the terms that base spans overlap."""

    def checked(xs: Column) -> Column:
        ends = _running(xs, F.lit(0), lambda at, s: F.when(s["kind"] < TERM, F.greatest(at, s["end"])).otherwise(at))
        starts = F.reverse(_running(F.reverse(xs), F.lit((1 << 31) - 1), lambda at, s: F.when(s["kind"] < TERM, F.least(at, s["start"])).otherwise(at)))
        marked = F.arrays_zip(xs.alias("span"), ends.alias("before"), starts.alias("after"))
        free = F.filter(marked, lambda m: (m["span"]["kind"] < TERM) | ((m["before"] <= m["span"]["start"]) & (m["after"] >= m["span"]["end"])))
        return F.transform(free, lambda m: m["span"])

    return _let(spans, checked)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(k: int):
    return lambda kind: kind == k


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_sha256 and spans of every whole text."""
    df = with_spans(docs.select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return df.select("row.doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _rewritten(text: Column, spans: Column) -> Column:
    """The text with <KIND> for each span; one that begins inside another is covered by it. The text is cut into parts of PART
    characters first, since places in a long one are found slowly."""
    names = F.array(*[F.lit(f"<{kind.upper()}>") for kind in KINDS])

    def written(both: Column) -> Column:
        parts, xs = both["parts"], both["spans"]

        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / PART).cast("int")
            joined = F.array_join(F.slice(parts, first + 1, F.floor((b - 1) / PART).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(joined, a - first * PART + 1, b - a)).otherwise("")

        ends = _running(xs, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
        out = F.zip_with(xs, ends, lambda s, at: F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.element_at(names, s["kind"] + 1))).otherwise(""))
        last = F.aggregate(xs, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
        return F.array_join(F.concat(out, F.array(_let(last, lambda at: between(at, both["size"])))), "")

    both = F.struct(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0)).alias("parts"), spans.alias("spans"), F.length(text).alias("size"))
    return _let(both, written)


def sanitize(docs: DataFrame) -> DataFrame:
    """All columns, with base values in text replaced by <KIND> and disclosing terms by <TERM>; a null text stays null."""
    df = with_spans(docs)
    text = F.when(F.size("spans") > 0, _rewritten(_text(), F.col("spans"))).otherwise(F.col("row.text"))
    return df.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op7_pii(spark, sf_dir):
    from basinflow.llm.common import table

    return personal_spans(table(spark, sf_dir, "documents"))
