"""Line deduplication: lines that many documents share go, wherever they stand.

Lines are exploded, their keys (stripped, ASCII lower case) hashed to 128 bits, and the documents of each hash counted, once for each
document and hash. What passes the threshold is stored. A second pass marks the lines that have such a hash: 64 lines make one word
of bits, so that a document meets its marks by position and is put together again from its own array of lines. Only hashes, numbers
and bits are shuffled for the counts; a text is only where its document joins its marks. DataFrame functions alone are used.

Defined cases: a null or empty text is one empty line; rows that repeat a doc_id, null among them, are one document; a key of fewer
than `least_chars` code points is never dropped; a document that loses all its lines has the empty text; an empty table gives no
rows. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import fresh, materialize, table

LEAST_DOCS, LEAST_CHARS = 10, 1
SPACE = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = 64


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case. Plain ASCII takes the faster way to the same letters."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(*parts: Column) -> list[Column]:
    """128 bits as two longs."""
    return [F.xxhash64(F.lit(salt), *parts).alias(name) for salt, name in ((1, "h1"), (2, "h2"))]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame, kept: list[Column], least_chars: int) -> DataFrame:
    """One row (kept columns, pos, h1, h2, long_enough) for each line."""
    lines = docs.select(*kept, F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    names = lines.columns[:-2]
    keys = lines.select(*names, "pos", line_key(F.col("line")).alias("key"))
    return keys.select(*names, "pos", *_hashes(F.col("key")), (F.length("key") >= least_chars).alias("long_enough"))


def frequent_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, n_docs) of the keys in at least so many documents. A document is its doc_id. Pairs of key and document are made
    single before they are counted, so a key that stands in a third of all lines is spread over all tasks."""
    document = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("document")
    once = _keyed(docs, [document], least_chars).where("long_enough").select("document", "h1", "h2").distinct()
    return once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least_docs)


def drop_frequent_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """All rows and columns with the text that is left, and two columns more: lines before, and lines dropped."""
    frequent = materialize(frequent_lines(docs, least_docs, least_chars))
    row = (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    ids = [c.alias(n) for c, n in zip(_hashes(*row), ("row1", "row2"))]
    lines = _keyed(docs, ids, least_chars)
    marked = lines.join(frequent.select("h1", "h2", F.lit(True).alias("drop")), ["h1", "h2"], "left")
    bit = F.when(F.col("drop") & F.col("long_enough"), F.expr(f"shiftleft(1L, pos % {WORD})")).otherwise(F.lit(0).cast("long"))
    words = marked.groupBy("row1", "row2", F.expr(f"pos div {WORD}").alias("word")).agg(F.bit_or(bit).alias("bits"))
    marks = words.groupBy("row1", "row2").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("marks"))
    marks = materialize(marks.select("row1", "row2", F.col("marks.bits").alias("bits")).where(F.exists("bits", lambda b: b != 0)))
    whole, m1, m2, bits, lines_of, kept = fresh(docs.columns, "whole", "m1", "m2", "bits", "lines_of", "kept")
    marks = marks.select(F.col("row1").alias(m1), F.col("row2").alias(m2), F.col("bits").alias(bits))
    ids = [c.alias(n) for c, n in zip(_hashes(*row), fresh(docs.columns, "row1", "row2"))]
    placed = docs.select("*", *ids)
    r1, r2 = placed.columns[-2:]
    placed = placed.join(marks, (F.col(r1) == F.col(m1)) & (F.col(r2) == F.col(m2)), "left").withColumn(lines_of, _lines(F.col("text")))

    def stays(_, i: Column) -> Column:
        word = F.get(F.col(bits), F.call_function("div", i, F.lit(WORD)).cast("int"))
        return F.getbit(word, i % WORD) == 0

    text = F.when(F.col(bits).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter(lines_of, stays), "\n"))
    dropped = F.coalesce(F.aggregate(bits, F.lit(0).cast("long"), lambda n, b: n + F.bit_count(b)), F.lit(0).cast("long"))
    n_lines, n_dropped = fresh(docs.columns, *names)
    counted = placed.withColumns({n_lines: F.size(lines_of).cast("long"), n_dropped: dropped, kept: text})
    return counted.select(*[(F.col(kept) if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns], n_lines, n_dropped)


def op11_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = f"""
with numbered as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), arrays as (select r, doc_id, string_split(text, chr(10)) as a from numbered
), lines as (select r, doc_id, unnest(a) as line, unnest(range(1, len(a) + 1)) as pos from arrays
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as key from lines
), frequent as (
  select key from keyed where length(key) >= {LEAST_CHARS} group by key
  having count(distinct coalesce(doc_id::varchar, 'null')) >= {LEAST_DOCS}
), judged as (select k.*, f.key is not null as gone from keyed k left join frequent f on k.key = f.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by r
"""
