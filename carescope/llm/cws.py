"""Document fingerprints by consistent weighted sampling.

Terms are the words of a text (lower-cased, parted by blanks), weights their counts. For each term
and each of ``SAMPLES`` samplers, hashes give r and c from Gamma(2, 1) and beta from U(0, 1). With
weight w: t = floor(ln w / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r; the sampler
takes the term of least a. Two texts take the same (term, t) with a chance equal to the
generalised Jaccard similarity of their weights (sum of lesser over sum of greater weights), and
as a is a function of term and t, equal least a tell it. A fingerprint is eight hex digits of a
hash of each sampler's least a; likeness is the share of equal samplers.

A text is fingerprinted together with an edited one (its last quarter replaced by the beginning of
the next document): both are counted in one aggregation by document and word. That aggregation
needs no shuffle, since texts already lie partitioned by document; all is DataFrame expressions.

Cases: a null text counts as empty; texts without words have the fingerprint of no term, equal
among themselves and likeness 0 with others; null ids come last in the order of documents.
Documents of equal id are ordered by a hash of the text; a row repeated with id and text counts
once in that order, and its result is repeated as often as the row. The only document is its own
next. An empty table gives an empty result. Only the id and text columns are read, so other
columns, whatever their names, do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carescope.llm.common import cut_lineage, row_numbers, whole_text

SAMPLES = 32
BLANKS = r"[\x20\x09-\x0D]+"
QUARTER = 4                 # the last 1/QUARTER of the characters is edited
KEY = ["no_id", "id", "text_hash"]     # never null, so that joins and aggregations share their partitioning


def _uniform(bits: Column) -> Column:
    """32 bits -> a number strictly between 0 and 1."""
    return (bits.cast("double") + 0.5) / 4294967296.0


def _high(h: Column) -> Column:
    return F.shiftrightunsigned(h, 32)


def _low(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFFFFFF))


def ln_sample(term_hash: Column, ln_weight: Column, sampler: int) -> Column:
    """ln a of a term of that weight (null: not in the text) for one sampler."""
    one, two, three = (F.xxhash64(term_hash, F.lit(3 * sampler + k)) for k in range(3))
    r = -F.ln(_uniform(_high(one)) * _uniform(_low(one)))
    c = -F.ln(_uniform(_high(two)) * _uniform(_low(two)))
    beta = _uniform(_high(three))
    return F.ln(c) - r * (F.floor(ln_weight / r + beta).cast("double") - beta + 1.0)


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: KEY, n_chars, times (how often the row occurs), text, edited, and the next document's
    key as next_*."""
    text = whole_text(text_col)
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.isNull().cast("int").alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"),
                       F.xxhash64(text).alias("text_hash"), text.alias("text"))
    narrow = (rows.select(*KEY, F.char_length("text").cast("long").alias("n_chars"))
              .groupBy(*KEY, "n_chars").agg(F.count(F.lit(1)).alias("times")))
    numbered, n = row_numbers(narrow, KEY)
    last = F.lit(max(n, 1))

    def neighbour(prefix: str, back: int, *more: Column) -> DataFrame:
        """The keys of the rows, numbered by the row that lies ``back`` places from them."""
        return numbered.select(F.pmod(F.col("row_number") + back, last).alias("row_number"),
                               *[F.col(k).alias(f"{prefix}_{k}") for k in KEY], *more)
    wanted = F.floor(F.col("n_chars") / QUARTER).cast("int").alias("wanted")
    links = numbered.join(neighbour("next", -1), "row_number").join(neighbour("prev", 1, wanted), "row_number").drop("row_number")
    linked = rows.join(links, KEY)
    pieces = (linked.select(*[F.col(f"prev_{k}").alias(k) for k in KEY], F.expr("substring(text, 1, wanted)").alias("piece"))
              .groupBy(*KEY).agg(F.first("piece").alias("piece")))
    edited = F.concat(F.expr(f"substring(text, 1, cast(n_chars - floor(n_chars / {QUARTER}) as int))"), F.col("piece"))
    return linked.join(pieces, KEY).select(*KEY, "n_chars", "times", "text", edited.alias("edited"), *[f"next_{k}" for k in KEY])


def term_weights(texts: DataFrame) -> DataFrame:
    """Per document (KEY) and hash of a word: ln of its counts in text and in edited, null if not there."""
    sides = texts.select(*KEY, "times", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")),
                                                          F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("s"))
    words = sides.select(*KEY, "times", F.col("s.side").alias("side"), F.explode(F.split(F.lower("s.t"), BLANKS)).alias("word"))
    terms = words.select(*KEY, "times", "side", F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    counted = terms.groupBy(*KEY, "times", "term").agg(F.sum(1 - F.col("side")).alias("own"), F.sum("side").alias("other"))

    def ln_weight(count: str) -> Column:
        return F.when(F.col("term").isNotNull() & (F.col(count) > 0), F.ln(F.col(count) / F.col("times")))
    return counted.select(*KEY, "term", ln_weight("own").alias("ln_own"), ln_weight("other").alias("ln_other"))


def fingerprints(texts: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """KEY, own and other: arrays of ``samples`` hashes, of the text and of the edited text."""
    term = F.col("term")
    least = [F.min(ln_sample(term, F.col(ln), k)).alias(f"{name}{k}")
             for name, ln in (("own", "ln_own"), ("other", "ln_other")) for k in range(samples)]
    per_doc = term_weights(texts).groupBy(*KEY).agg(*least)

    def hashes(name: str) -> Column:
        return F.array(*[F.when(F.col(f"{name}{k}").isNotNull(), F.shiftrightunsigned(F.xxhash64(f"{name}{k}", F.lit(k)), 32))
                         .otherwise(F.lit(0)) for k in range(samples)]).alias(name)
    return per_doc.select(*KEY, hashes("own"), hashes("other"))


def likeness(a: str, b: str) -> Column:
    """Share of equal samplers."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return same.cast("double") / F.size(a)


def as_text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = edited_texts(docs, id_col, text_col)
    about = texts.select(*KEY, "n_chars", *[f"next_{k}" for k in KEY], F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    own = cut_lineage(about.join(fingerprints(texts, samples), KEY))
    following = own.select(*[F.col(k).alias(f"next_{k}") for k in KEY], F.col("own").alias("next_own")).dropDuplicates([f"next_{k}" for k in KEY])
    return own.join(following, [f"next_{k}" for k in KEY]).select(
        F.when(F.col("no_id") == 0, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", as_text("own").alias("fingerprint"),
        as_text("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"))
